"""The pipeline against plain versions of its stages, each on what the one before kept."""

import random

import brute
import pandas as pd
from pyspark.sql import functions as F
from test_brute import WORDS, prose
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import bpe, decontamination


def test_run(spark, tmp_path):
    rng = random.Random(5)
    items = [(k, prose(rng, 14)) for k in range(3)]
    rows, labels = [], []
    for k in range(120):
        text = f"Printed on page {k} of the volume\n{prose(rng, 60)}"
        if k % 4 == 1:
            words = text.split(" ")
            for at in (20, 35, 50):
                words[at] = "zorgvile"
            text = " ".join(words)
        if k % 10 == 2:
            text += f" {items[k % 3][1]} {prose(rng, 5)}"
        labels.append((k, 1, int(k % 4 == 1)))
        rows.append((k, text))
    rows += [(200 + k, rows[k][1].replace(WORDS[k], "other", 1)) for k in range(0, 40, 4)]
    rows += [(300, None), (301, "")]
    frame = pd.DataFrame(rows, columns=["doc_id", "text"]).assign(lang="en", source="s", n_chars=1)
    frame.to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).to_parquet(tmp_path / "labels.parquet")
    pd.DataFrame(items, columns=["item_id", "text"]).to_parquet(tmp_path / "benchmark.parquet")

    kept = [(i, t) for i, t in rows if "zorgvile" not in (t or "")]
    left = brute.recurring_lines(kept)
    kept = [(i, left[i][2] if t else t) for i, t in kept if not left[i][1] or left[i][2].strip()]
    of = brute.near_duplicates(kept)
    kept = [(i, t) for i, t in kept if of[i][1] == i]
    leaks = {i for i, t in kept for _, p in items if brute.nearest_part(p, decontamination.folded(t or "")) <= int(len(p) * decontamination.DISTANCE)}
    assert leaks
    kept = [(i, t) for i, t in kept if i not in leaks]
    tokenizer = Tokenizer.from_file(bpe.tokenizer_file())
    tokenizer.no_truncation()
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in kept}
    assert {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    odd = docs.select("*", *[F.lit("x").alias(c) for c in ("score", "predicted", "id", "places", "left", "dropped", "row", "token_ids", "decoded")])
    odd = odd.union(odd.filter("doc_id < 2")).union(odd.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns, name
        assert out.filter("score = 'x' AND decoded = 'x'").count() == out.count() > 0

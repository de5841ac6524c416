"""What op10 moves and leaves on disk, and the helpers that work on many texts at once."""

import glob
import random
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

from tidemark.llm import paragraphs, queries
from tidemark.llm.minhash import SHINGLE, shingle_set


def text(rng, n):
    return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))


def test_shuffled_files_go(spark, tmp_path):
    """No job but the last leaves what it shuffled on disk until the driver collects garbage."""
    rng = random.Random(3)
    rows = [(k, text(rng, 60)) for k in range(40)]
    rows += [(100 + k, f"{t} more") for k, t in rows]
    pd.DataFrame(rows, columns=["doc_id", "text"]).to_parquet(tmp_path / "documents.parquet")
    folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before, name = shuffled(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name)
    out = queries.QUERIES["op10_paragraphs"](spark, str(tmp_path))
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get(name) == setting
    assert sorted(r["doc_id"] for r in out.collect() if r["n_removed"]) == list(range(100, 140))


def test_pairs_that_are_not_moved(spark, monkeypatch):
    """Lines too different in length, and bands whose only pair was compared, are not compared on their sets."""
    rng = random.Random(4)
    rows = [(k, text(rng, 45)) for k in range(60)]
    rows += [(100 + k, f"{t} {text(rng, 30)}") for k, t in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sent, again = [], []
    sets, missed = paragraphs.line_sets, paragraphs.missed_links
    monkeypatch.setattr(paragraphs, "line_sets", lambda places, wanted, *a: sent.append(wanted.count()) or sets(places, wanted, *a))
    monkeypatch.setattr(paragraphs, "missed_links", lambda keyed, *a: again.append(keyed.count()) or missed(keyed, *a))
    lines = paragraphs.cut(paragraphs.units(docs)).filter("signature IS NOT NULL")
    assert paragraphs.met_lines(lines).count() > 20
    assert not paragraphs.line_components(lines, docs).count()
    assert sum(sent) == 0 and again == [0]


def test_words_of_many_texts():
    rng = random.Random(5)
    texts = ["", None, "  ", "a b\tC \n\n d E\x0bf g\n", "É é x y z w\r\n v", *(text(rng, rng.randrange(40)) for _ in range(30)), "q " * 300, None]
    w, words = paragraphs.in_words(pa.array(texts)), lambda t: [b.split() for b in (t or "").encode().lower().split(b"\n")]
    assert np.diff(w.texts).tolist() == [sum(map(len, words(t))) for t in texts]
    assert np.diff(w.lines).tolist() == [len(x) for t in texts for x in words(t)]
    for k, t in enumerate(texts):
        i, j = int(w.texts[k]), int(w.texts[k + 1]) - SHINGLE + 1
        if i < j:
            assert np.array_equal(np.unique(w.g[i:j]), shingle_set(t, {x: xxhash.xxh3_64_intdigest(x) for b in words(t) for x in b}))
    rows = list(paragraphs.text_slices(pa.array(["x" * 5_000_000, "y" * 5_000_000, None, "z" * 20_000_000, ""])))
    assert [(r.start, r.stop) for r in rows] == [(0, 1), (1, 3), (3, 4), (4, 5)]


def test_distinct_values_and_runs():
    rng = np.random.default_rng(6)
    g = rng.integers(0, 60, 500).astype(np.uint64)
    begin = rng.integers(0, 480, 200)
    end = begin + rng.integers(1, 20, 200)
    assert paragraphs.distinct_in(g, begin, end).tolist() == [len(np.unique(g[i:j])) for i, j in zip(begin, end)]
    of, start = rng.integers(0, 20, 200), rng.integers(0, 300, 200)
    stop = start + rng.integers(5, 30, 200)
    want = []
    for k in range(20):
        runs = []
        for i, j in sorted(zip(start[of == k].tolist(), stop[of == k].tolist())):
            if runs and i <= runs[-1][2]:
                runs[-1][2] = max(runs[-1][2], j)
            else:
                runs.append([k, i, j])
        want += [r for r in runs if r[2] - r[1] >= 19]
    assert np.stack(paragraphs._merged(of, start, stop, 19), axis=1).tolist() == want
    assert not len(paragraphs._merged(of[:0], start[:0], stop[:0], 19)[0])

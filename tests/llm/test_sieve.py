"""The bit filter before joins: what is wanted passes, and most of the rest is not moved."""

import random

from tidemark.llm import minhash
from tidemark.llm.sieve import sieved


def test_sieve(spark):
    rng = random.Random(3)
    keys = [rng.randrange(-(2**63), 2**63) for _ in range(4000)]
    rows = spark.createDataFrame([(k, f"t{k}") for k in [*keys, *keys[:100], None]], "id bigint, sieve_word string")
    wanted = spark.createDataFrame([(k,) for k in [*keys[:1000], None]], "key bigint")
    got = sieved(rows, "id", wanted)
    assert got.columns == ["id", "sieve_word"]
    ids = [r["id"] for r in got.collect()]
    assert set(ids) >= set(keys[:1000]) and len(ids) <= 1500 and None not in ids
    assert sum(i in set(keys[:100]) for i in ids) == 200
    assert sieved(rows, "id", wanted.limit(0)).count() == 0


def test_texts_without_candidates_stay(spark, monkeypatch):
    """Only texts of candidate pairs are read by the exact join, which shuffles them."""
    passed = []
    kept = minhash.sieved
    monkeypatch.setattr(minhash, "sieved", lambda rows, key, wanted: passed.append((key, kept(rows, key, wanted))) or passed[-1][1])
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) for _ in range(300)]
    rows = [*enumerate(texts), (1000, texts[7] + " more")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: 7 if i == 1000 else i for i, _ in rows}
    moved = [df.count() for key, df in passed if key == "doc_id"]
    assert len(moved) == 2 and max(moved) <= 40

"""Families over whole tables, and label spreading that does not settle."""

import random

import pytest

from tidemark.operators import review
from tidemark.plans import registry


def components(links):
    label = {x: x for p in links for x in p}
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_whole_tables(spark, tmp_path):
    rng = random.Random(13)
    orders = [(k, rng.randrange(1, 60)) for k in range(1, 81)]
    lines = [(k, rng.randrange(1, 40)) for k, _ in orders if k % 3]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    links = [(3 * c, 3 * k + 1) for k, c in orders] + [(3 * s + 2, 3 * k + 1) for k, s in lines]
    want = components(links)
    got = {r["id"]: r["family"] for r in registry.QUERIES["media_families_whole"](spark, str(tmp_path)).collect()}
    assert got == want and len(set(want.values())) > 1


def test_unsettled_families_raise(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        review.families(chain, rounds=2)
    assert {r["family"] for r in review.families(chain).collect()} == {0}


def test_components_of_many_links_are_dealt_by_their_number(spark, monkeypatch):
    from tidemark.operators import components as C

    rng = random.Random(3)
    links = [(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(180)) if a != b]
    monkeypatch.setattr(C, "ROWS_EACH", 20)
    dealt = []
    before = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, *how: dealt.append(how[0]) or before(self, *how))
    got = {r["id"]: r["component"] for r in C.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == components(links) and max(dealt) > 2

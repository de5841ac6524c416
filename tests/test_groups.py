"""Groups that go over batches, with nulls, lists and none at all."""

import pyarrow as pa
import pytest

from tidemark.operators import groups as G


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_groups_over_batches(size):
    keys = [None, None, "a", "a", "a", "b", "c", "c", None, "d", "d", "d", "d"]
    table = pa.table({"k": keys, "j": pa.array([1] * 4 + [2] * 9), "x": pa.array(range(13)), "l": [[k] for k in range(13)]})
    got = [(g["k"][0], g["j"][0], g["x"].tolist(), g["l"].tolist()) for g in G.each_group(table.to_batches(max_chunksize=size), ["k", "j"])]
    assert [x[:3] for x in got] == [(None, 1, [0, 1]), ("a", 1, [2, 3]), ("a", 2, [4]), ("b", 2, [5]), ("c", 2, [6, 7]), (None, 2, [8]), ("d", 2, [9, 10, 11, 12])]
    assert [y for x in got for y in x[3]] == [[k] for k in range(13)]
    assert list(G.each_group([], ["k"])) == []


def test_solved_groups(spark):
    rows = spark.createDataFrame([(k % 7 if k % 11 else None, 100 - k, float(k), f"t{k}") for k in range(100)], "k int, at int, v double, t string").repartition(5)
    out = G.solve_groups(rows, ["k"], ["at"], lambda g: [(g["k"][0], len(g["at"]), g["at"].tolist(), g["t"][0])], "k int, n bigint, at array<int>, first string").collect()
    assert sum(r["n"] for r in out) == 100 and len(out) == 8
    assert all(list(r["at"]) == sorted(r["at"]) and r["first"] == f"t{100 - r['at'][0]}" for r in out)
    assert G.solve_groups(rows.limit(0), ["k"], ["at"], lambda g: [], "k int").collect() == []

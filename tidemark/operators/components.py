"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut, ship_package

#: Links a task folds at a time; what it forwards is a forest of these.
FOLD_ROWS = 500_000
#: Links that a task sorts or groups, on average, once they are too many for the session's number of partitions.
ROWS_EACH = 500_000


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(p, p)
            x = p
        return x

    def flush() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in list(parent) if root(x) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
        if len(parent) > FOLD_ROWS:
            yield flush()
    yield flush()


def connected_components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component) for every id of ``links`` (a, b); the component is its smallest id.

    Each task first folds its links to a forest; then rounds of large stars (larger neighbours move to the smallest
    one) and small stars (smaller neighbours move to the smallest one) run until nothing changes, which takes a
    number of rounds logarithmic in the longest path; the number of tasks grows with the links.  Every round is cut off in the shared checkpoint folder.
    """
    ship_package(links.sparkSession)
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut(edges.mapInArrow(_folded, "a bigint, b bigint"))

    def dealt(rows: DataFrame, count: int, by: str) -> DataFrame:
        parts = -(-count // ROWS_EACH)
        return rows.repartition(parts, by) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = dealt(edges.union(edges.select("b", "a")).toDF("u", "v"), 2 * before[0], "u")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = dealt(large, before[0], "a").distinct()
        nearest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(nearest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        moved = moved.union(nearest.select("a", F.col("m").alias("b")))
        edges = cut(dealt(moved, before[0], "a").distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    inner = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return inner.union(roots)

"""Joins and folds over half-open intervals [start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Listed intervals up to which they are sent to every task instead of moving the points.
SENT_ROWS = 200_000


def point_in_interval_join(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str, width: int, how: str = "inner", counted: bool = False) -> DataFrame:
    """Points with the intervals that hold them, by equality of ``on`` and of the ``width``-wide bucket.

    Each interval is listed in every bucket that it touches, so the join is an equi-join at any size; the exact
    bounds are checked on top.  With ``counted`` the listed intervals are counted first: up to SENT_ROWS of them are
    broadcast and the points stay where they are, so that no key of theirs can be a hot one.
    """
    cells = F.sequence(F.floor(F.col(start) / width), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / width))
    spread = intervals.withColumn("_cell", F.explode(cells))
    if counted and (intervals.agg(F.sum(F.size(cells))).first()[0] or 0) <= SENT_ROWS:
        spread = F.broadcast(spread)
    keyed = points.withColumn("_cell", F.floor(F.col(at) / width))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    same = [keyed[c] == spread[c] for c in [*on, "_cell"]]
    joined = keyed.join(spread, [*same, inside], how)
    for c in [*on, "_cell"]:
        joined = joined.drop(spread[c])
    return joined.drop("_cell")


def band_semi_join(left: DataFrame, right: DataFrame, on: list[str], at: str, other: str, tolerance: int) -> DataFrame:
    """Rows of ``left`` with a row of ``right`` at most ``tolerance`` away; neighbouring buckets are met by listing."""
    cell = F.floor(F.col(at) / tolerance)
    near = right.select(*on, F.col(other).alias("_other"), F.explode(F.array(*[F.floor(F.col(other) / tolerance) + d for d in (-1, 0, 1)])).alias("_cell"))
    keyed = left.withColumn("_cell", cell)
    same = [keyed[c] == near[c] for c in [*on, "_cell"]]
    return keyed.join(near, [*same, F.abs(keyed[at] - near["_other"]) <= tolerance], "left_semi").drop("_cell")


def merge_intervals(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Maximal intervals per key; ones that touch are merged."""
    w = W.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.coalesce(F.col(start) > reach, F.lit(True)).cast("int")
    marked = rows.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(*by, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def interval_gaps(rows: DataFrame, by: list[str], start: str, end: str, whole: DataFrame | None = None) -> DataFrame:
    """Uncovered stretches of a key: between its merged intervals or, with ``whole`` (by, begin, finish), in all of
    that range, head and tail and keys without intervals included."""
    if whole is not None:
        # Empty intervals at both ends are merged with what they touch, so only what is uncovered lies between.
        ends = whole.filter("begin < finish").select(*by, F.explode(F.array("begin", "finish")).alias(start)).withColumn(end, F.col(start))
        held = rows.join(whole, by).select(*by, F.greatest(F.col(start), F.col("begin")).alias(start), F.least(F.col(end), F.col("finish")).alias(end)).filter(F.col(start) < F.col(end))
        rows = held.unionByName(ends)
    w = W.partitionBy(*by).orderBy(start)
    merged = merge_intervals(rows, by, start, end).withColumn("_next", F.lead(start).over(w))
    return merged.filter(F.col("_next").isNotNull()).select(*by, F.col(end).alias("gap_start"), F.col("_next").alias("gap_end"))


def coverage_bands(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Stretches of constant depth: one edge up at a start, one down at an end, summed along the axis."""
    edges = rows.select(*by, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = edges.groupBy(*by, F.col("e.at").alias("band_start")).agg(F.sum("e.d").alias("d"))
    w = W.partitionBy(*by).orderBy("band_start")
    # Where as many end as begin the depth stays, and so does the band.
    bands = steps.filter("d <> 0").withColumns({"depth": F.sum("d").over(w), "band_end": F.lead("band_start").over(w)})
    return bands.filter((F.col("depth") > 0) & F.col("band_end").isNotNull()).select(*by, "band_start", "band_end", F.col("depth").cast("long").alias("depth"))


def overlapping_pairs(rows: DataFrame, key: str, by: list[str], start: str, end: str, width: int) -> DataFrame:
    """Pairs (a, b), a < b, of intervals of one key that overlap, met in the first bucket that both touch."""
    cells = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    spread = rows.filter(F.col(end) > F.col(start)).select(*by, F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e"), F.explode(cells).alias("cell"))
    a, b = spread.alias("a"), spread.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*by, "cell"]]
    meet = (F.col("a.k") < F.col("b.k")) & (F.col("a.s") < F.col("b.e")) & (F.col("b.s") < F.col("a.e"))
    first = F.col("a.cell") == F.floor(F.greatest(F.col("a.s"), F.col("b.s")) / width)
    return a.join(b, [*same, meet, first]).select(*[F.col(f"a.{c}").alias(c) for c in by], F.col("a.k").alias("a"), F.col("b.k").alias("b"))


def nearest_before(rows: DataFrame, reference: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """As-of join: each row with the latest ``value`` of ``reference`` at or before it, in one pass over both."""
    left = rows.select("*", F.lit(None).cast(reference.schema[value].dataType).alias("_value"), F.lit(1).alias("_side"))
    right = reference.select(*[F.col(c) for c in by], F.col(at), F.col(value).alias("_value"), F.lit(0).alias("_side"))
    w = W.partitionBy(*by).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = left.unionByName(right, allowMissingColumns=True).withColumn(f"last_{value}", F.last("_value", ignorenulls=True).over(w))
    return both.filter("_side = 1").drop("_side", "_value")


def runs(rows: DataFrame, by: list[str], order: list[str], value: Column) -> DataFrame:
    """Run number of equal consecutive values (gaps and islands)."""
    w = W.partitionBy(*by).orderBy(*order)
    changed = (~value.eqNullSafe(F.lag(value).over(w))).cast("int")
    return rows.withColumn("_changed", F.when(F.row_number().over(w) == 1, 1).otherwise(changed)).withColumn("run", F.sum("_changed").over(w)).drop("_changed")

"""Clips, cuts, visibility and density of timed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resolve_clips(items: DataFrame, clips: DataFrame, asset: str, at: str) -> DataFrame:
    """One row per enabled clip and item inside it, with its place on the line (``line_ms``).

    Clips are an editor's list; the join is on the asset, with the half-open window as residual, and AQE picks its form.
    """
    live = clips.filter("enabled").withColumnRenamed("asset_id", asset)
    inside = (F.col(at) >= F.col("in_ms")) & (F.col(at) < F.col("out_ms"))
    return items.join(live, asset).filter(inside).withColumn("line_ms", F.col("line_start") + F.col(at) - F.col("in_ms") + F.col("local_ms"))


def apply_cuts(rows: DataFrame, markers: DataFrame, at: str, out: str) -> DataFrame:
    """Times moved by the gaps of all markers at or before them; gaps are looked up on the time before moving.

    The markers, an editor's list, become stretches between one and the next with the sum of the gaps so far, in which
    the rows' times are looked up; behind the last one all gaps count.
    """
    from tidemark.operators.intervals import point_in_interval_join

    low, high, n, whole = markers.agg(F.min("at_ms"), F.max("at_ms"), F.count(F.lit(1)), F.sum("gap_ms")).first()
    if not n:
        return rows.withColumn(out, F.col(at))
    w = W.orderBy("at_ms")
    sums = markers.groupBy("at_ms").agg(F.sum("gap_ms").alias("gap")).withColumns({"_gap": F.sum("gap").over(w), "_to": F.lead("at_ms").over(w)})
    stretches = sums.filter("_to IS NOT NULL").select(F.col("at_ms").alias("_from"), "_to", "_gap")
    found = point_in_interval_join(rows, stretches, [], at, "_from", "_to", max(1, (high - low) // (4 * n)), "left", counted=True)
    gap = F.when(F.col(at) >= high, F.lit(whole)).otherwise(F.coalesce("_gap", F.lit(0)))
    return found.withColumn(out, F.col(at) + gap).drop("_from", "_to", "_gap")


def density(rows: DataFrame, at: str, width: int) -> DataFrame:
    """(bucket, n) from the first bucket to the last, empty ones included."""
    counts = rows.groupBy(F.floor(F.col(at) / width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).filter("a IS NOT NULL")
    every = span.select(F.explode(F.sequence("a", "b")).alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def visible_at(rows: DataFrame, at: str, live: Column, moment: int, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows on screen at a moment, ends included."""
    return rows.filter((F.col(at) <= moment) & (F.col(at) + live >= moment)).orderBy(*order).limit(limit)


def playback_coverage(rows: DataFrame, by: list[str], order: list[str], at: str, longest: int) -> DataFrame:
    """Time credited between consecutive reports that are at most ``longest`` apart, and the number of sessions."""
    gap = F.col(at) - F.lag(at).over(W.partitionBy(*by).orderBy(*order))
    marked = rows.withColumn("_gap", gap)
    credited = F.sum(F.when(F.col("_gap").between(0, longest), F.col("_gap")).otherwise(0)).alias("credited_ms")
    return marked.groupBy(*by).agg(credited, F.count_if(F.col("_gap").isNull() | (F.col("_gap") > longest)).alias("sessions"))


def append_offsets(rows: DataFrame, by: list[str], order: list[str], length: str, out: str) -> DataFrame:
    """Where each segment begins when a key's segments are laid end to end."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long"))

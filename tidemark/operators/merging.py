"""Windows and splits of long sources, cuts from matches, and bookkeeping of merged parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.edits import clamp_ms
from tidemark.operators.intervals import band_semi_join, merge_intervals, runs

#: A boundary may be this share of a part away from its even place, in a silence of at least so long; of several the
#: best has the longest silence less this share of its distance (fixed values).
NEAR, SILENCE_MS, DISTANCE_COST = 0.35, 60_000, 0.2
#: Length of a stable stretch, observations that give full support, and the match threshold (fixed values).
STABLE_MS, STABLE_COUNT, THRESHOLD = 10_000, 5, 0.18
#: Intervals that a task sorts, on average.
ROWS_EACH = 500_000


def windowed(rows: DataFrame, by: list[str], at: str, mode: Column, first: Column, second: Column, out: str) -> DataFrame:
    """Rows inside their key's window, with the time since the window's start.

    Modes: ``prefix`` (length ``first``), ``suffix`` (the last ``first``), ``range`` (``first`` to ``second``), and
    anything else for all.
    """
    ends = rows.groupBy(*by).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    start = F.when(mode == "prefix", F.lit(0)).when(mode == "suffix", F.greatest(F.lit(0), F.col("_b") - clamp_ms(first))).when(mode == "range", clamp_ms(first)).otherwise(F.col("_a"))
    stop = F.when(mode == "prefix", clamp_ms(first)).when(mode == "range", clamp_ms(second)).otherwise(F.col("_b") + 1)
    inside = rows.join(ends, by).withColumns({"_s": start, "_e": stop}).filter((F.col(at) >= F.col("_s")) & (F.col(at) < F.col("_e")))
    return inside.withColumn(out, F.greatest(F.lit(0), F.col(at) - F.col("_s")).cast("long")).drop("_a", "_b", "_s", "_e")


def inferred_boundaries(rows: DataFrame, by: list[str], at: str, parts: str) -> DataFrame:
    """(by, place, boundary_ms, found): inner boundaries of a source of ``parts`` episodes.

    The windows around even places do not meet, so each silence can serve one boundary only and all are found at once;
    without a silence the even place is taken.
    """
    w = W.partitionBy(*by).orderBy(at)
    ends = rows.groupBy(*by).agg(F.min(at).alias("_a"), F.max(at).alias("_b"), F.max(parts).alias("_n"))
    length = F.greatest(F.lit(1), F.col("_b") - F.col("_a")) / F.col("_n")
    silent = rows.select(*by, F.col(at).alias("_l"), F.lead(at).over(w).alias("_r")).filter(F.col("_r") - F.col("_l") >= SILENCE_MS)
    middle = (F.col("_l") + F.col("_r")) / 2
    placed = silent.join(ends, by).withColumns({"_m": middle, "_part": length}).withColumn("place", F.round((F.col("_m") - F.col("_a")) / F.col("_part")).cast("int"))
    away = F.abs(F.col("_m") - F.col("_a") - F.col("_part") * F.col("place"))
    near = placed.filter((F.col("place") >= 1) & (F.col("place") < F.col("_n")) & (away <= F.col("_part") * NEAR))
    best = near.groupBy(*by, "place").agg(F.max_by("_m", F.struct(F.col("_r") - F.col("_l") - away * DISTANCE_COST, -F.col("_l"))).alias("_m"))
    wanted = ends.filter("_n > 1").withColumn("place", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int") - 1)))
    even = F.col("_a") + length * F.col("place")
    return wanted.join(best, [*by, "place"], "left").select(*by, "place", clamp_ms(F.coalesce("_m", even)).alias("boundary_ms"), F.col("_m").isNotNull().alias("found"))


def split_at_boundaries(rows: DataFrame, boundaries: DataFrame, by: list[str], at: str) -> DataFrame:
    """``rows`` with ``part``, from 0: how many of their key's boundaries lie at or before them."""
    marks = boundaries.select(*by, F.col("boundary_ms").alias(at), F.lit(1).alias("_mark"))
    both = rows.withColumn("_mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy(at).rangeBetween(W.unboundedPreceding, 0)
    return both.withColumn("part", F.sum("_mark").over(w)).filter("_mark = 0").drop("_mark")


def cuts_from_matches(matches: DataFrame, by: list[str], source: str, target: str, distance: str, least: int) -> DataFrame:
    """Places where the target runs ahead of the source by ``least`` or more between neighbouring matches."""
    w = W.partitionBy(*by).orderBy(source, target)
    s, t, d = F.lag(source).over(w), F.lag(target).over(w), F.lag(distance).over(w)
    seen = matches.withColumns({"_s": s, "_t": t, "_d": d}).withColumn("gap_ms", (F.col(target) - F.col("_t")) - (F.col(source) - F.col("_s")))
    confidence = F.greatest(F.lit(0.1), F.least(F.lit(0.95), 1 - (F.col("_d") + F.col(distance)) / (2 * THRESHOLD)))
    return seen.filter(F.col("gap_ms") >= least).select(*by, F.col("_s").alias("range_start"), F.col(source).alias("range_end"), "gap_ms", F.round(confidence, 6).alias("confidence"))


def cuts_from_anchors(anchors: DataFrame, by: list[str], source: str, target: str, name: str, least: int) -> DataFrame:
    """(by, at_ms, gap_ms): anchors at which the offset to the target has grown by ``least`` or more since the one before."""
    w = W.partitionBy(*by).orderBy(source, target, name)
    offset = F.col(target) - F.col(source)
    grown = (offset - F.lag(offset).over(w)).cast("long")
    return anchors.select(*by, F.greatest(F.col(source), F.lit(0)).alias("at_ms"), grown.alias("gap_ms")).filter(F.col("gap_ms") >= least)


def change_points(observations: DataFrame, by: list[str], at: str, offset: str, distance: str, step: int, least: int) -> DataFrame:
    """Where a rounded offset rises by ``least`` or more and stays for a stable stretch."""
    rounded = observations.withColumn("_o", (F.floor(F.col(offset) / step + 0.5) * step).cast("long"))
    islands = runs(rounded, by, [at], F.col("_o")).groupBy(*by, "run", "_o").agg(F.min(at).alias("_a"), F.max(at).alias("_b"), F.count(F.lit(1)).alias("n"), F.avg(distance).alias("_d"))
    w = W.partitionBy(*by).orderBy("_a")
    seen = islands.withColumns({"_po": F.lag("_o").over(w), "_pb": F.lag("_b").over(w)})
    span = F.greatest(F.lit(step), F.col("_b") - F.col("_a") + step)
    support = F.least(F.lit(1.0), F.col("n") / STABLE_COUNT)
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_d") / THRESHOLD))
    confidence = F.greatest(F.lit(0.1), F.least(F.lit(0.98), 0.45 + support * 0.35 + near * 0.15))
    kept = seen.filter((F.col("_o") - F.col("_po") >= least) & (span >= max(STABLE_MS, step * STABLE_COUNT)))
    return kept.select(*by, F.floor((F.col("_pb") + F.col("_a")) / 2 + 0.5).cast("long").alias("at_ms"), (F.col("_o") - F.col("_po")).alias("gap_ms"), F.col("n").alias("support"), F.round(confidence, 6).alias("confidence"))


def every_nth(rows: DataFrame, by: list[str], order: list[str], stride: int) -> DataFrame:
    """The first of every ``stride`` rows of a key, and its last row."""
    w = W.partitionBy(*by).orderBy(*order)
    placed = rows.withColumns({"_i": F.row_number().over(w) - 1, "_next": F.lead(F.lit(1)).over(w)})
    return placed.filter((F.col("_i") % stride == 0) | F.col("_next").isNull()).drop("_i", "_next")


def union_length(rows: DataFrame, by: list[str], start: str, end: str, out: str, counted: bool = False) -> DataFrame:
    """Per key the length that its intervals cover together.  With ``counted`` the intervals are counted first, and the
    number of tasks that sort them grows with them."""
    if counted:
        rows = rows.select(*by, start, end).repartition(max(1, -(-rows.count() // ROWS_EACH)), *by)
    return merge_intervals(rows, by, start, end).groupBy(*by).agg(F.sum(F.col(end) - F.col(start)).alias(out))


def conflicting_keys(left: DataFrame, right: DataFrame, on: list[str], start: str, end: str, tolerance: int, width: int) -> DataFrame:
    """Keys under which an interval of each side overlap by more than ``tolerance``; they meet in buckets of ``width``."""

    def spread(rows: DataFrame, side: str) -> DataFrame:
        cells = F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / width))
        return rows.select(*on, F.col(start).alias(f"_{side}s"), F.col(end).alias(f"_{side}e"), F.explode(cells).alias("_cell"))

    met = spread(left, "l").join(spread(right, "r"), [*on, "_cell"])
    over = F.least("_le", "_re") - F.greatest("_ls", "_rs")
    return met.filter(over > tolerance).select(*on).distinct()


def upsert(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``held`` with the rows of ``new`` in place of those of the same key."""
    return held.join(new.select(key), key, "left_anti").select(*held.columns).unionByName(new.select(*held.columns))


def cluster_details(hits: DataFrame, by: list[str], at: str, ordinal: str, text: str, weight: str, labels: str, width: int, least: int, samples: int) -> DataFrame:
    """Clusters of at least ``least`` hits in windows of ``width``: middle time, score, level, keywords and first texts.

    Hits come by time and, of one time, by their original order; keywords (an array per hit) by their first hit.  Hits
    are numbered inside their window, and only the texts shown and one row for each keyword are gathered.
    """
    keyed = hits.withColumn("bucket", F.floor(F.col(at) / width))
    keys = [*by, "bucket"]
    placed = keyed.withColumns({"_i": F.row_number().over(W.partitionBy(*keys).orderBy(at, ordinal)), "_n": F.count(F.lit(1)).over(W.partitionBy(*keys))}).filter(F.col("_n") >= least)
    shown = F.array_sort(F.collect_list(F.when(F.col("_i") <= samples, F.struct(F.col("_i").alias("i"), F.col(text).alias("x")))))
    grouped = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hits"), F.sum(weight).alias("score"), F.min(at).alias("start_ms"), F.max(at).alias("end_ms"),
        F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2) + 1, F.col(at))).alias("middle_ms"), F.array_join(F.transform(shown, lambda s: s["x"]), "|").alias("samples"),
    )
    words = placed.select(*keys, "_i", F.posexplode(labels).alias("_p", "_k")).groupBy(*keys, "_k").agg(F.min(F.struct("_i", "_p")).alias("_f"))
    words = words.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_f", "_k"))), lambda s: s["_k"]), "|").alias("keywords"))
    level = F.when((F.col("hits") >= 5) | (F.col("score") >= 12), "high").when((F.col("hits") >= 3) | (F.col("score") >= 7), "medium").otherwise("low")
    return grouped.join(words, keys, "left").select(*keys, "hits", "score", "start_ms", "end_ms", "middle_ms", level.alias("level"), F.coalesce("keywords", F.lit("")).alias("keywords"), "samples")


def cluster_applied(clusters: DataFrame, markers: DataFrame, by: list[str], at: str, marker: str, tolerance: int = 15_000) -> DataFrame:
    """``clusters`` with whether a marker stands within ``tolerance`` of their middle."""
    near = band_semi_join(clusters, markers, by, at, marker, tolerance).select(*by, at).distinct().withColumn("applied", F.lit(True))
    return clusters.join(near, [*by, at], "left").withColumn("applied", F.coalesce("applied", F.lit(False)))

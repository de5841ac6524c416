"""Bounds, slices, nearest rows, axes and even samples of ordered events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import fresh

#: Steps of a clock axis in milliseconds, pixels that a label needs, and bucket widths by pixels a second (fixed values).
STEPS_MS = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10_000, 15_000, 30_000, 60_000, 120_000, 300_000, 600_000, 900_000, 1_800_000, 3_600_000)
LABEL_PIXELS = 95
BUCKETS_MS = ((18, 30_000), (45, 10_000), (130, 1000), (420, 500))


def bounds(rows: DataFrame, at: str, probes: list[int]) -> DataFrame:
    """(probe, lower, upper): how many rows lie before each of a few times, and before or at it; one pass."""
    counts = rows.agg(*[f.alias(f"{name}{k}") for k, p in enumerate(probes) for name, f in (("l", F.count_if(F.col(at) < p)), ("u", F.count_if(F.col(at) <= p)))])
    each = F.array(*[F.struct(F.lit(p).cast("long").alias("probe"), F.col(f"l{k}").alias("lower"), F.col(f"u{k}").alias("upper")) for k, p in enumerate(probes)])
    return counts.select(F.inline(each))


def in_range(rows: DataFrame, at: str, start: int, end: int) -> DataFrame:
    """Rows between two times, both included."""
    return rows.filter(F.col(at).between(start, end))


def bucket_width(pixels_per_second: Column) -> Column:
    """Width of density buckets for a zoom."""
    out = F.lit(100)
    for below, width in reversed(BUCKETS_MS):
        out = F.when(pixels_per_second < below, F.lit(width)).otherwise(out)
    return out


def axis_step(duration: Column, pixels: Column) -> Column:
    """The first clock step that leaves room for labels; whole hours beyond the last one."""
    wanted = duration / F.greatest(F.lit(1), F.floor(pixels / LABEL_PIXELS))
    fit = F.get(F.filter(F.array(*[F.lit(s) for s in STEPS_MS]), lambda s: s >= wanted), F.lit(0))
    return F.coalesce(fit.cast("long"), F.ceil(wanted / 3_600_000) * 3_600_000)


def axis_ticks(rows: DataFrame, start: str, end: str, pixels: int) -> DataFrame:
    """``rows`` with ``step_ms`` and one row per tick ``tick_ms`` between start and end."""
    length = F.greatest(F.lit(1), F.col(end) - F.col(start))
    stepped = rows.withColumn("step_ms", axis_step(length, F.lit(pixels)))
    first = F.ceil(F.col(start) / F.col("step_ms")) * F.col("step_ms")
    ticks = F.when(first <= F.col(end), F.sequence(first, F.col(end), F.col("step_ms")))
    return stepped.withColumn("tick_ms", F.explode(ticks))


def clock(ms: Column, fine: Column) -> Column:
    """``[h:]mm:ss[.fff]``."""
    v = F.greatest(F.lit(0), ms)
    hours = F.floor(v / 3_600_000)
    base = F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"))).otherwise(""), F.format_string("%02d:%02d", F.floor(v / 60_000) % 60, F.floor(v / 1000) % 60))
    return F.when(fine, F.concat(base, F.format_string(".%03d", v % 1000))).otherwise(base)


def nearest(left: DataFrame, right: DataFrame, on: list[str], at: str, value: str, out: str) -> DataFrame:
    """``left`` with the ``value`` and time of the nearest row of ``right``, the later one of two as near.

    Times outside the right side's first and last find nothing.  Both sides go through one sort per key; running
    values carry the last row before and the first one behind.
    """
    carried = F.struct(F.col(at).alias("t"), F.col(value).alias("v"))
    both = left.select(*on, at, F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(carried.alias("c")).schema["c"].dataType).alias("_c")).unionByName(
        right.select(*on, at, F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("_row"), carried.alias("_c"))
    )
    w = W.partitionBy(*on).orderBy(at)
    before, after = F.max("_c").over(w.rangeBetween(W.unboundedPreceding, 0)), F.min("_c").over(w.rangeBetween(0, W.unboundedFollowing))
    seen = both.withColumns({"_before": before, "_after": after}).filter(F.col("_row").isNotNull())
    inside = F.col("_before").isNotNull() & F.col("_after").isNotNull()
    chosen = F.when(inside, F.when(F.col("_after.t") - F.col(at) <= F.col(at) - F.col("_before.t"), F.col("_after")).otherwise(F.col("_before")))
    return seen.select("_row.*", chosen["v"].alias(out), chosen["t"].alias(f"{out}_at"))


def braced_offset(left: DataFrame, right: DataFrame, on: list[str], at: str, offset: str, tolerance: int, reach: int, out: str) -> DataFrame:
    """``left`` with the mean offset of the anchors before and behind; null if they differ by more than ``tolerance``.

    With an anchor on one side only, its offset counts within ``reach``.  Of anchors at one time, the largest offset
    counts before and the smallest behind.
    """
    w = W.partitionBy(*on).orderBy(at)
    anchor = F.struct(F.col(at).alias("t"), F.col(offset).alias("o"))
    kind = right.select(anchor.alias("c")).schema["c"].dataType
    both = left.select(*left.columns, F.lit(None).cast(kind).alias("_c"), F.lit(True).alias("_left")).unionByName(right.select(*on, at, anchor.alias("_c"), F.lit(False).alias("_left")), allowMissingColumns=True)
    seen = both.withColumns({"_b": F.max("_c").over(w.rangeBetween(W.unboundedPreceding, 0)), "_a": F.min("_c").over(w.rangeBetween(0, W.unboundedFollowing))}).filter("_left")
    b, a = F.col("_b.o"), F.col("_a.o")
    mean = ((a + b) / 2).cast("long")
    single = F.when(F.col("_a").isNull() & (F.col(at) - F.col("_b.t") <= reach), b).when(F.col("_b").isNull() & (F.col("_a.t") - F.col(at) <= reach), a)
    return seen.withColumn(out, F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.when(F.abs(a - b) <= tolerance, mean)).otherwise(single)).select(*left.columns, out)


def even_sample(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of every key, evenly spaced by place, first and last included.

    Row i is kept if some k has i = floor(k * (n - 1) / (most - 1) + 1/2).
    """
    w = W.partitionBy(*by)
    placed = rows.withColumns({"_n": F.count(F.lit(1)).over(w), "_i": F.row_number().over(w.orderBy(*order)) - 1})
    step = (F.col("_n") - 1) / F.lit(most - 1)
    k = F.ceil((F.col("_i") - 0.5) / step)
    hit = (F.floor(k * step + 0.5) == F.col("_i")) & (k <= most - 1)
    return placed.filter((F.col("_n") <= most) | hit).drop("_n", "_i")


def block_starts(frames: Column, block: int, stride: int, most: int) -> Column:
    """Starts of blocks every ``stride`` frames, the last one at the end, thinned evenly to ``most``."""
    end = frames - block
    plain = F.sequence(F.lit(0).cast("long"), end, F.lit(stride).cast("long"))
    full = F.when(F.element_at(plain, -1) < end, F.concat(plain, F.array(end))).otherwise(plain)
    n = F.size(full)
    thin = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(full, F.floor(i * (n - 1) / max(1, most - 1)).cast("int"))))
    return F.when(end < 0, F.array().cast("array<bigint>")).when(n > most, thin).otherwise(full)


def bottom_k(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of every key in ``order``, which should leave no ties.

    Spark keeps ``k`` rows of a key in every partition before it moves any (WindowGroupLimit, for up to 1,000), so no
    task is handed more than ``k`` for each partition, whatever a key's share.
    """
    (place,) = fresh(rows, "_place")
    return rows.withColumn(place, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(place) <= k).drop(place)

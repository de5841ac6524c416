"""Edits of clips, selections and exports as DataFrame operations; lists of ids are tables, not driver-side sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CLIP = ["clip_id", "asset_id", "line_start", "in_ms", "out_ms", "local_ms", "enabled"]
#: Shortest room that an arranged asset without a known length takes (fixed value).
LEAST_ROOM_MS = 30_000


def clamp_ms(ms: Column) -> Column:
    """Whole milliseconds, halves rounded up, never negative."""
    return F.greatest(F.lit(0).cast("long"), F.floor(ms + F.lit(0.5)).cast("long"))


def union_ids(held: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """``held`` with the ids of ``chosen``, each once."""
    return held.select(key).union(chosen.select(key)).distinct()


def without_ids(held: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """``held`` without the ids of ``chosen``."""
    return held.select(key).distinct().join(chosen.select(key), key, "left_anti")


def first_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of every key; an aggregate, so a key's rows are combined before they move.

    Of rows that ``order`` leaves open the one whose other columns are smallest is taken, so how rows are dealt to
    tasks does not matter.
    """
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order, *(c for c in rest if c not in order))).alias("first")).select(*key, "first.*")


def distinct_in_order(rows: DataFrame, by: list[str], value: str, order: list[str], out: str) -> DataFrame:
    """Per key, the distinct values in the order in which they first came."""
    firsts = rows.groupBy(*by, value).agg(F.min(F.struct(*order)).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", F.col(value).alias("v"))))
    return firsts.groupBy(*by).agg(F.transform(ordered, lambda x: x["v"]).alias(out))


def clips_with_assets(clips: DataFrame, assets: DataFrame, asset: str) -> DataFrame:
    """Clips whose asset exists."""
    return clips.join(assets.select(asset).distinct(), asset, "left_semi")


def placement_summary(assets: DataFrame, clips: DataFrame, asset: str, enabled: Column) -> DataFrame:
    """One row: how many assets there are, are placed, and are placed without any clip that is on."""
    placed = clips.groupBy(asset).agg(F.max(enabled).alias("live"))
    state = assets.select(asset).distinct().join(placed, asset, "left")
    return state.agg(
        F.count(F.lit(1)).alias("asset_count"), F.count_if(F.col("live").isNotNull()).alias("placed_count"), F.count_if(~F.col("live")).alias("disabled_count"), F.count_if(F.col("live").isNull()).alias("unplaced_count")
    )


def unplaced(assets: DataFrame, clips: DataFrame, asset: str) -> DataFrame:
    """Assets without a clip."""
    return assets.join(clips.select(asset), asset, "left_anti")


def merge_adjustments(held: DataFrame, chosen: DataFrame, key: str, ms: str, delta: int | None = None, value: int | None = None) -> DataFrame:
    """Time adjustments per item after moving the chosen items by ``delta`` or setting theirs to ``value``."""
    both = held.select(key, ms).join(chosen.select(key).distinct().withColumn("_chosen", F.lit(True)), key, "full")
    old = F.coalesce(F.col(ms), F.lit(0).cast("long"))
    new = F.lit(value).cast("long") if delta is None else old + F.lit(delta)
    return both.select(key, F.when(F.col("_chosen"), new).otherwise(old).alias(ms))


def move(rows: DataFrame, chosen: Column, at: str, delta: int) -> DataFrame:
    """``rows`` with the chosen ones moved; no time becomes negative."""
    return rows.withColumn(at, F.when(chosen, clamp_ms(F.col(at) + F.lit(delta))).otherwise(F.col(at)))


def visual_start(prefix: str = "") -> Column:
    return F.col(f"{prefix}line_start") + F.col(f"{prefix}local_ms")


def visual_end(prefix: str = "") -> Column:
    return visual_start(prefix) + F.greatest(F.col(f"{prefix}out_ms") - F.col(f"{prefix}in_ms"), F.lit(0))


def split_clips(clips: DataFrame, at: str) -> DataFrame:
    """Clips cut at the line time ``at``: (CLIP, side); side is A or B, or null where the cut does not fall inside."""
    inner = F.col("in_ms") + F.col(at) - visual_start()
    fits = F.coalesce((F.col(at) > visual_start()) & (F.col(at) < visual_end()) & (inner > F.col("in_ms")) & (inner < F.col("out_ms")), F.lit(False))

    def side(name: str | None, line: Column, first: Column, last: Column) -> Column:
        return F.struct(F.lit(name).cast("string").alias("side"), line.alias("line"), first.alias("first"), last.alias("last"))

    line, first, last = F.col("line_start"), F.col("in_ms"), F.col("out_ms")
    parts = F.when(fits, F.array(side("A", line, first, inner), side("B", clamp_ms(F.col(at) - F.col("local_ms")), inner, last))).otherwise(F.array(side(None, line, first, last)))
    cut = clips.withColumn("_part", F.explode(parts))
    made = {"line_start": F.col("_part.line"), "in_ms": F.col("_part.first"), "out_ms": F.col("_part.last")}
    return cut.select(*[made.get(c, F.col(c)).alias(c) for c in CLIP], F.col("_part.side").alias("side"))


def merge_clips(clips: DataFrame, by: str, slack: int = 1) -> DataFrame:
    """One clip for every group of at least two clips that continue each other on both axes and have one asset."""
    w = W.partitionBy(by).orderBy("line_start", "clip_id", "in_ms")
    before = clips.withColumns({"_end": F.lag(visual_end()).over(w), "_out": F.lag("out_ms").over(w), "_asset": F.lag("asset_id").over(w)})
    joined = F.col("_end").isNull() | ((F.abs(F.col("_end") - visual_start()) <= slack) & (F.abs(F.col("_out") - F.col("in_ms")) <= slack) & (F.col("_asset") == F.col("asset_id")))
    order = F.struct("line_start", "clip_id", "in_ms")
    first = [F.min_by(c, order).alias(c) for c in ("clip_id", "asset_id", "line_start", "in_ms")]
    merged = before.groupBy(by).agg(*first, F.max_by("out_ms", order).alias("out_ms"), F.min_by("local_ms", order).alias("local_ms"), F.bool_and("enabled").alias("enabled"), F.count(F.lit(1)).alias("n"), F.bool_and(joined).alias("whole"))
    return merged.filter("n >= 2 AND whole").select(by, *[c for c in CLIP if c != by])


def arrange(assets: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Assets laid end to end per key: (by, order, line_start, in_ms, out_ms).

    ``assets`` has earliest_ms and latest_ms, its first and last comment, and known_ms, its length where it is known.
    """
    first, last, known = F.col("earliest_ms"), F.col("latest_ms"), F.col("known_ms")
    room = F.when(known.isNotNull(), F.greatest(known, last + 1)).otherwise(F.greatest(F.lit(LEAST_ROOM_MS), last - first))
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(room).over(w), F.lit(0)).cast("long")
    return assets.select(
        *by, *order, begin.alias("line_start"), F.when(known.isNotNull(), F.lit(0)).otherwise(first).cast("long").alias("in_ms"), F.greatest(F.coalesce(known, F.lit(0)), last + 1, first + 1).cast("long").alias("out_ms")
    )


def append_unplaced(assets: DataFrame, clips: DataFrame, by: list[str], asset: str, order: list[str]) -> DataFrame:
    """New clips (by, asset, line_start, out_ms) for the assets of a key that have none, behind everything placed."""
    ends = clips.groupBy(*by).agg(F.max(visual_end()).alias("_end"))
    new = assets.join(clips.select(*by, asset).distinct(), [*by, asset], "left_anti").withColumn("out_ms", F.greatest(F.coalesce("known_ms", F.lit(0)), F.col("latest_ms") + 1).cast("long"))
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("out_ms").over(w), F.lit(0))
    return new.withColumn("_before", before).join(ends, by, "left").select(*by, asset, (F.greatest(F.coalesce("_end", F.lit(0)), F.lit(0)) + F.col("_before")).cast("long").alias("line_start"), "out_ms")


#: What a file name may not hold, and endings of media files that a name loses (fixed values).
RESERVED = r'[\\/:*?"<>|]+'
MEDIA_ENDING = r"(?i)\.(?:mp4|mkv|mov|avi|webm|m4v|ts|m2ts|flv|wmv|mp3|m4a|aac|flac|wav|ogg|opus)$"


def export_name(name: Column, fallback: Column) -> Column:
    """A safe name for an exported file."""
    base = F.regexp_replace(F.trim(name), MEDIA_ENDING, "")
    return F.concat(F.regexp_replace(F.when(base != "", base).otherwise(fallback), RESERVED, "_"), F.lit(".xml"))


def unique_names(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with names made different, whatever their case: all of several equal ones get the next free number.

    A number is free if no name that occurs once has it.  A group of n equal names needs at most n numbers more than
    there are such names that begin like it, so the numbers are made and sieved as a table.
    """
    low = F.lower(F.col(name))
    named = rows.withColumns({"_low": low, "_base": F.regexp_replace(F.col(name), r"(?i)\.xml$", "")})
    sizes = named.groupBy("_low").agg(F.count(F.lit(1)).alias("_n"))
    once = sizes.filter("_n = 1").select(F.col("_low").alias("_used"))
    numbered = once.withColumn("_root", F.regexp_extract("_used", r"^(.*)-[0-9]+\.xml$", 1)).filter("_root <> ''").groupBy("_root").agg(F.count(F.lit(1)).alias("_taken"))
    many = sizes.filter("_n > 1").withColumn("_root", F.regexp_replace("_low", r"\.xml$", ""))
    free = many.join(numbered, "_root", "left").select("_low", "_root", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n") + F.coalesce("_taken", F.lit(0)))).alias("_number"))
    free = free.withColumn("_used", F.concat("_root", F.lit("-"), F.col("_number").cast("string"), F.lit(".xml"))).join(once, "_used", "left_anti")
    free = free.withColumn("_place", F.row_number().over(W.partitionBy("_low").orderBy("_number"))).select("_low", "_place", "_number")
    placed = named.withColumn("_place", F.row_number().over(W.partitionBy("_low").orderBy(key)))
    chosen = placed.join(sizes, "_low").join(free, ["_low", "_place"], "left")
    made = F.when(F.col("_n") > 1, F.concat("_base", F.lit("-"), F.col("_number").cast("string"), F.lit(".xml"))).otherwise(F.col(name))
    return chosen.withColumn("unique_name", made).select(*rows.columns, "unique_name")


def suite_changes(baseline: DataFrame, candidate: DataFrame, suite: str, worse: dict[str, float]) -> DataFrame:
    """(suite, change) of two runs; ``worse`` gives how far a metric may rise (if positive) or fall (if negative)."""
    names = list(worse)
    a = baseline.select(suite, F.struct(*names).alias("a"))
    b = candidate.select(suite, F.struct(*names).alias("b"))
    broken = F.lit(False)
    for name, most in worse.items():
        delta = F.col(f"b.{name}") - F.col(f"a.{name}")
        broken = broken | ((delta > most) if most >= 0 else (delta < most))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "missing").when(broken, "regressed").otherwise("held")
    return a.join(b, suite, "full").select(suite, change.alias("change"))

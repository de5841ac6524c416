"""Merging of many source files into episodes: windows, splits of files that hold several episodes, and running offsets.

Files (asset_id, file_name, source_order, season, first_episode, last_episode, part, known_ms) become segments, a row
each, and segments of one episode follow each other.  Items (asset_id, item_id, original_index, at_ms) are only looked
up in the segments of their file; nothing gathers a file's or an episode's items.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.edits import clamp_ms
from tidemark.operators.merging import inferred_boundaries

SEGMENT = ["asset_id", "file_name", "source_order", "season", "episode", "part", "start_ms", "stop_ms", "length_ms", "warning"]


@dataclass(frozen=True)
class Window:
    """``full``, ``prefix`` and ``suffix`` of ``first`` ms, or ``range`` from ``first`` to ``second``."""

    mode: str = "full"
    first: int = 0
    second: int = 0


def _extent(items: DataFrame) -> DataFrame:
    return items.groupBy("asset_id").agg(F.min("at_ms").alias("_a"), F.max("at_ms").alias("_b"))


def single_segments(files: DataFrame, items: DataFrame, window: Window = Window()) -> DataFrame:
    """Segments of files with one episode.

    A file's known length, which counts only as far as it covers the last item, gives the end of the whole file and of
    suffixes; without it the last item does, and a whole file's length is left to its items.  Empty windows are told
    (emptyWindow), as are windows without items (noItems).
    """
    rows = files.filter("last_episode <= first_episode").join(_extent(items), "asset_id", "left")
    a, b = F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))
    known = F.greatest(F.col("known_ms"), b + 1)
    known = F.when(F.col("known_ms").isNotNull(), known)
    first, second = (clamp_ms(F.lit(x)) for x in (window.first, window.second))
    if window.mode == "prefix":
        start, stop = F.lit(0), first
    elif window.mode == "suffix":
        start, stop = F.greatest(F.lit(0), F.when(known.isNotNull(), known - F.lit(window.first)).otherwise(b - first)), F.coalesce(known, b + 1)
    elif window.mode == "range":
        start, stop = first, second
    else:
        start, stop = F.when(known.isNotNull(), F.lit(0)).otherwise(a), F.coalesce(known, b + 1)
    rows = rows.withColumns({"start_ms": start.cast("long"), "stop_ms": stop.cast("long"), "_known": known})
    open_ = (F.lit(window.mode == "full")) & F.col("_known").isNull()
    length = F.when(F.col("stop_ms") <= F.col("start_ms"), F.lit(0)).when(~open_, F.col("stop_ms") - F.col("start_ms"))
    met = F.col("_a").isNull() | ((F.col("_a") < F.col("stop_ms")) & (F.col("_b") >= F.col("start_ms")))
    warning = F.when(F.col("stop_ms") <= F.col("start_ms"), "emptyWindow").when(~met, "noItems")
    return rows.withColumns({"length_ms": length.cast("long"), "warning": warning, "episode": F.col("first_episode")}).select(*SEGMENT)


def episode_lengths(files: DataFrame, known: DataFrame) -> DataFrame:
    """(asset_id, k, length_ms) of all episodes of files for which the known lengths suffice.

    ``known`` is (place, season, episode, length_ms), in the order of ``place`` from 0.  Lengths of the episodes'
    own numbers come first, where every one is there (seasons must agree if both are told, the first entry counts);
    for files without season then the entries at the numbers' places; then the first ones that are not empty.
    """
    rows = files.filter("last_episode > first_episode").select("asset_id", "season", "first_episode", (F.col("last_episode") - F.col("first_episode") + 1).alias("n"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).withColumn("episode", F.col("first_episode") + F.col("k"))
    m = known.select(F.col("place").alias("_place"), F.col("season").alias("_season"), F.col("episode").alias("_episode"), F.col("length_ms").alias("_length"))
    agree = (F.col("episode") == F.col("_episode")) & (F.col("season").isNull() | F.col("_season").isNull() | (F.col("season") == F.col("_season")))
    exact = rows.join(m, agree).groupBy("asset_id", "k").agg(F.min_by("_length", "_place").alias("exact")).filter("exact > 0")
    placed = rows.filter("season IS NULL").join(m, F.col("_place") == F.col("episode") - 1).filter("_length > 0").select("asset_id", "k", F.col("_length").alias("placed"))
    rest = m.filter("_length > 0").withColumn("_k", F.row_number().over(W.orderBy("_place")) - 1)  # a project's own short list
    first = rows.join(rest, F.col("_k") == F.col("k")).select("asset_id", "k", F.col("_length").alias("first"))
    found = rows.select("asset_id", "n", "k")
    for part in (exact, placed, first):
        found = found.join(part, ["asset_id", "k"], "left")
    whole = {c: F.count(c).over(W.partitionBy("asset_id")) == F.col("n") for c in ("exact", "placed", "first")}
    length = F.when(whole["exact"], F.col("exact")).when(whole["placed"], F.col("placed")).when(whole["first"], F.col("first"))
    return found.withColumn("length_ms", length).filter("length_ms IS NOT NULL").select("asset_id", "k", "length_ms")


def range_segments(files: DataFrame, items: DataFrame, cuts: list[int] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Segments of files that hold several episodes, the last one's end included.

    With ``cuts`` the first ones inside a file part it, with ``known`` the episodes' lengths do; a file for which these
    do not suffice is parted at silences.  Files without items have empty segments.  Warnings: cuts, lengths,
    lengthsTail (items behind the last length are lost), even (no silence was found), noItems (nothing to part).
    """
    rows = files.filter("last_episode > first_episode").join(_extent(items), "asset_id", "left").withColumn("n", F.col("last_episode") - F.col("first_episode") + 1)
    held = rows.filter("_a IS NOT NULL")
    keep = [*files.columns, "n", "_a", "_b"]

    def borders(inner: Column, last: Column, warning: Column) -> list[Column]:
        return [F.concat(F.array("_a"), inner, F.array(last)).alias("borders"), warning.alias("warning")]

    parts, rest = [], held
    if cuts is not None:
        inside = F.filter(F.array_sort(F.array(*[clamp_ms(F.lit(c)) for c in cuts])), lambda c: (c > F.col("_a")) & (c < F.col("_b")))
        rest = rest.withColumn("_in", F.slice(inside, 1, F.col("n") - 1))
        parts.append(rest.filter(F.size("_in") == F.col("n") - 1).select(*keep, *borders(F.col("_in"), F.col("_b") + 1, F.lit("cuts"))))
        rest = rest.filter(F.size("_in") < F.col("n") - 1).drop("_in")
    elif known is not None:
        lengths = episode_lengths(files, known).groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("k", "length_ms"))).alias("_l"))
        rest = rest.join(lengths, "asset_id", "left")
        sums = F.transform(F.sequence(F.lit(1), F.size("_l")), lambda j: F.col("_a") + F.aggregate(F.slice("_l", F.lit(1), j), F.lit(0).cast("long"), lambda s, x: s + x["length_ms"]))
        told = rest.filter("_l IS NOT NULL").withColumn("_s", sums)
        tail = F.when(F.element_at("_s", -1) < F.col("_b"), "lengthsTail").otherwise("lengths")
        parts.append(told.select(*keep, F.concat(F.array("_a"), "_s").alias("borders"), tail.alias("warning")))
        rest = rest.filter("_l IS NULL").drop("_l")
    timed = items.join(rest.select("asset_id", "n"), "asset_id")
    silent = inferred_boundaries(timed, ["asset_id"], "at_ms", "n").groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("place", "boundary_ms"))).alias("_in"), F.bool_and("found").alias("_found"))
    parts.append(rest.join(silent, "asset_id").select(*keep, *borders(F.transform("_in", lambda x: x["boundary_ms"]), F.col("_b") + 1, F.when(~F.col("_found"), "even"))))
    parts.append(rows.filter("_a IS NULL").select(*keep, F.array_repeat(F.lit(0).cast("long"), F.col("n") + 1).alias("borders"), F.lit("noItems").alias("warning")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    out = whole.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    start, stop = F.get("borders", F.col("k")), F.get("borders", F.col("k") + 1)
    last = F.col("k") == F.col("n") - 1
    named = out.withColumns({"episode": F.col("first_episode") + F.col("k"), "part": F.col("k") + 1, "start_ms": start, "length_ms": clamp_ms(stop - start), "stop_ms": F.when(last, stop + 1).otherwise(stop)})
    return named.select(*SEGMENT)


def merged_entries(segments: DataFrame, items: DataFrame) -> DataFrame:
    """(season, episode, asset_id, item_id, original_index, part, final_ms): every item on its episode's clock.

    An episode's segments follow each other by source order, part and name; each moves those behind it by its length
    or, if that is not known, by its last item's time.
    """
    pieces = segments.select("asset_id", "part", "season", "episode", "start_ms", "stop_ms")
    met = items.join(pieces, "asset_id").filter((F.col("at_ms") >= F.col("start_ms")) & (F.col("at_ms") < F.col("stop_ms"))).withColumn("_t", clamp_ms(F.col("at_ms") - F.col("start_ms")))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("asset_id", "part", "episode")]
    reach = met.groupBy("asset_id", "part", "episode").agg(F.max("_t").alias("_m"))
    sized = segments.alias("l").join(reach.alias("r"), same, "left").select("l.*", F.greatest(F.lit(0), F.coalesce("l.length_ms", "r._m", F.lit(0))).alias("_size"))
    w = W.partitionBy("season", "episode").orderBy("source_order", F.coalesce("part", F.lit(0)), "file_name").rowsBetween(W.unboundedPreceding, -1)
    shifts = sized.withColumn("_shift", F.coalesce(F.sum("_size").over(w), F.lit(0))).select("asset_id", "part", "episode", "_shift")
    out = met.alias("l").join(shifts.alias("r"), same).select("l.*", "r._shift")
    return out.select("season", "episode", "asset_id", "item_id", "original_index", "part", (F.col("_t") + F.col("_shift")).alias("final_ms"))


def episodes(segments: DataFrame, entries: DataFrame) -> DataFrame:
    """(season, episode, label, file_name, files, items, warnings) of every episode, also those without items.

    Seasons are named only where there is more than one.
    """
    counts = entries.groupBy("season", "episode").agg(F.count(F.lit(1)).alias("items"))
    per = segments.groupBy("season", "episode").agg(F.array_sort(F.collect_set(F.struct("source_order", "file_name"))).alias("_f"), F.array_sort(F.collect_set("warning")).alias("warnings"))
    many = segments.agg((F.count_distinct("season") > 1).alias("_many")).first()["_many"]
    named = F.lit(bool(many)) & F.col("season").isNotNull()
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    wide = lambda c: F.when(F.col(c) < 100, two(c)).otherwise(F.col(c).cast("string"))
    name = F.when(named, F.concat(F.lit("S"), wide("season"), F.lit("E"), wide("episode"), F.lit(".xml"))).otherwise(F.concat(F.col("episode").cast("string"), F.lit(" - "), F.col("episode").cast("string"), F.lit(".xml")))
    label = F.when(named, F.concat(F.lit("第 "), F.col("season").cast("string"), F.lit(" 季 第 "), F.col("episode").cast("string"), F.lit(" 集"))).otherwise(F.concat(F.lit("第 "), F.col("episode").cast("string"), F.lit(" 集")))
    joined = per.alias("l").join(counts.alias("r"), F.col("l.season").eqNullSafe(F.col("r.season")) & (F.col("l.episode") == F.col("r.episode")), "left")
    flat = joined.select(F.col("l.season").alias("season"), F.col("l.episode").alias("episode"), "_f", "warnings", "items")
    return flat.select("season", "episode", label.alias("label"), name.alias("file_name"), F.array_distinct(F.transform("_f", lambda f: f["file_name"])).alias("files"), F.coalesce("items", F.lit(0)).alias("items"), "warnings")

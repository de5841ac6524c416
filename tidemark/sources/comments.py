"""Timed comments as XML files, rule texts, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions.text import display_ms, rgb_to_bgr_hex

_FILE = "d ARRAY<STRUCT<_p: STRING, _VALUE: STRING>>"
#: The fields of ``p`` behind the time, in the format's order (fixed values).
FIELDS = ["mode", "font_size", "color", "timestamp", "pool"]


def read_comment_xml(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """One row per ``<d p="...">`` in file order; rows are never dropped, faults become ``warnings``.

    A time that cannot be read becomes 0, missing numbers become null; Spark's reader gives no text where a comment
    holds blanks only.  ``mode="FAILFAST"`` refuses broken files.
    """
    files = spark.read.format("xml").option("rowTag", "i").option("mode", mode).option("ignoreSurroundingSpaces", "false").schema(_FILE).load(path).withColumn("asset_id", F.input_file_name())
    return parse_items(files.select("asset_id", F.posexplode("d").alias("original_index", "row")).select("asset_id", "original_index", F.col("row._p").alias("p"), F.col("row._VALUE").alias("text")))


def parse_items(rows: DataFrame) -> DataFrame:
    """Items from (asset_id, original_index, p, text)."""
    raw = F.split(F.coalesce("p", F.lit("")), ",", -1)
    seconds = F.when(F.get("raw", F.lit(0)).rlike(r"^[0-9]+(?:\.[0-9]+)?$"), F.get("raw", F.lit(0)).try_cast("decimal(20,6)"))
    faults = [
        F.when(F.col("p").isNull(), F.lit("missing_p")),
        F.when(F.size("raw") < 8, F.lit("short_p")),
        F.when(seconds.isNull(), F.lit("bad_time")),
        F.when(F.length(F.coalesce("text", F.lit(""))) == 0, F.lit("empty_text")),
    ]
    numbers = [rules.whole_number(F.get("raw", F.lit(k + 1))).alias(name) for k, name in enumerate(FIELDS)]
    return rows.withColumn("raw", raw).select(
        "asset_id", "original_index", F.coalesce(F.floor(seconds * 1000 + F.lit(0.5)).cast("long"), F.lit(0).cast("long")).alias("source_time_ms"), *numbers,
        F.get("raw", F.lit(6)).alias("user_hash"), F.get("raw", F.lit(7)).alias("row_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("raw").alias("raw_p_fields"), F.array_compact(F.array(*faults)).alias("warnings"),
    )


def _escaped(text: Column) -> Column:
    out = text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def comment_lines(items: DataFrame, at: str = "final_ms") -> DataFrame:
    """(target, at, original_index, line): ``<d>`` elements with the new time, negative times as 0, 8 fields."""
    seconds = F.format_string("%.3f", F.greatest(F.col(at), F.lit(0)) / 1000)
    padded = F.concat("raw_p_fields", F.array_repeat(F.lit("0"), F.greatest(8 - F.size("raw_p_fields"), F.lit(0))))
    fields = F.concat(F.array(seconds), F.slice(padded, 2, F.size(padded)))
    line = F.concat(F.lit('<d p="'), _escaped(F.array_join(fields, ",")), F.lit('">'), _escaped(F.col("text")), F.lit("</d>"))
    return items.select("target", F.col(at).alias("at"), "original_index", line.alias("line"))


def write_comment_xml(items: DataFrame, path: str, at: str = "final_ms") -> None:
    """One folder per target; its files hold whole documents, one per target, in time order."""
    lines = comment_lines(items, at)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "original_index", "line"))), lambda x: x["line"])
    body = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<i>\n'), F.array_join(ordered, "\n"), F.lit("\n</i>"))
    lines.groupBy("target").agg(body.alias("value")).write.partitionBy("target").text(path)


def ass_events(items: DataFrame, at: str = "t_ms", lanes: int = 10) -> DataFrame:
    """Subtitle events: lane by row number, standing or moving by mode, colour in blue-green-red order."""
    from pyspark.sql import Window as W

    lane = (F.row_number().over(W.partitionBy("target").orderBy(at, "original_index")) - 1) % lanes

    def stamp(ms: Column) -> Column:
        cs = F.floor(ms / 10)
        return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360_000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)

    move = F.when(F.col("mode") == 4, F.lit("\\an2")).when(F.col("mode") == 5, F.lit("\\an8")).otherwise(F.lit("\\move"))
    return items.select("target", "original_index", stamp(F.col(at)).alias("start"), stamp(F.col(at) + display_ms(F.col("mode"))).alias("stop"), lane.alias("lane"), move.alias("effect"), rgb_to_bgr_hex(F.coalesce("color", F.lit(0xFFFFFF))).alias("bgr"), "text")


def parse_cut_points(text: Column) -> Column:
    """Times of a rule text in order; equal ones stay, entries that are no times are in ``cut_point_faults``."""
    return F.array_sort(F.array_compact(F.transform(rules.cut_points(text), lambda x: x["at_ms"])))


def cut_point_faults(text: Column) -> Column:
    """Entries of a rule text that are no times."""
    return F.transform(F.filter(rules.cut_points(text), lambda x: x["at_ms"].isNull()), lambda x: x["text"])


def parse_anchors(text: Column) -> Column:
    """Anchors ``a -> b`` per line in order of their times, equal ones of their lines' names."""
    found = F.filter(rules.anchors(text), lambda x: x["fault"].isNull())
    made = F.transform(found, lambda x: F.struct(x["source_ms"].alias("source_ms"), x["target_ms"].alias("target_ms"), F.concat(F.lit("manual-anchor-"), x["line"].cast("string")).alias("id")))
    return F.array_sort(made)


def anchor_faults(text: Column) -> Column:
    """(line, fault, text) of lines that are no anchors."""
    return F.transform(F.filter(rules.anchors(text), lambda x: x["fault"].isNotNull()), lambda x: F.struct(x["line"].alias("line"), x["fault"].alias("fault"), x["text"].alias("text")))


def _plain_path(path: Column) -> Column:
    """A path without the slashes of an empty authority, which Spark's readers write differently."""
    return F.regexp_replace(path, "^([a-z]+:)/+", "$1/")


def read_comment_files(spark: SparkSession, path: str, most_items: int = 250_000, most_p: int = 16_384, most_fields: int = 64) -> DataFrame:
    """Items of every different file of ``path``, with its digest; equal files are read once.

    A broken file, or one beyond the bounds, stops the read with an error.
    """
    files = spark.read.format("binaryFile").load(path).select(_plain_path(F.col("path")).alias("_path"), F.sha2("content", 256).alias("digest"))
    first = files.groupBy("digest").agg(F.min("_path").alias("_path"))
    kept = read_comment_xml(spark, path, "FAILFAST").withColumn("_path", _plain_path(F.col("asset_id"))).join(first, "_path").drop("_path")
    counts = kept.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.length(F.array_join("raw_p_fields", ","))).alias("p"), F.max(F.size("raw_p_fields")).alias("f"))
    broken = counts.filter((F.col("n") > most_items) | (F.col("p") > most_p) | (F.col("f") > most_fields)).limit(1).collect()
    if broken:
        raise ValueError(f"file {broken[0]['digest']} is beyond the bounds")
    return kept


def round_trip_faults(items: DataFrame, back: DataFrame, at: str = "final_ms") -> DataFrame:
    """Rows of ``items`` whose time or text another read of what was written does not show, and rows it has in excess."""
    wanted = items.select(F.greatest(F.col(at), F.lit(0)).cast("long").alias("ms"), "text")
    got = back.select(F.col("source_time_ms").alias("ms"), "text")
    return wanted.exceptAll(got).withColumn("fault", F.lit("missing")).union(got.exceptAll(wanted).withColumn("fault", F.lit("added")))

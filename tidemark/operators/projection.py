"""Timed items of source assets on the clocks of target media, through confirmed segments and their time maps.

Tables: ``segments`` (segment_id, kind content or ignored, asset_id, source_media, target_media, map_id, source_start,
source_end, target_start), ``items`` (asset_id, item_id, original_index, at_ms, enabled), ``maps`` (map_id, state,
source_media, target_media, source_start, source_end, target_start, target_end, level, identity_ok), ``spans``
(timemap.SPAN_SCHEMA, level, decision), ``bindings`` (asset_id, source_media), ``media`` (media_id, role,
duration_ms), ``disabled`` (item_id) and ``adjustments`` (item_id, adjustment_ms).  All but the items are a project's
own small tables; items are looked up in them and are never grouped by a segment, an asset or a target.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import timemap
from tidemark.operators.intervals import point_in_interval_join

#: Roles that a segment's media must have (fixed values).
SOURCE_ROLE, TARGET_ROLE = "bilibiliReference", "targetOriginal"
#: Levels at which nothing may leave (fixed values).
STOPPED = ("blocked", "legacy-unverified")


def segment_conflicts(segments: DataFrame) -> DataFrame:
    """(left_id, right_id): segments of one asset and source that overlap where either is ignored or both have one target."""
    rows = segments.filter("asset_id IS NOT NULL AND source_media IS NOT NULL")
    a, b = rows.alias("a"), rows.alias("b")
    before = F.expr("a.source_start < b.source_start OR a.source_start = b.source_start AND (a.source_end < b.source_end OR a.source_end = b.source_end AND a.segment_id < b.segment_id)")
    same = (F.col("a.asset_id") == F.col("b.asset_id")) & (F.col("a.source_media") == F.col("b.source_media"))
    clash = F.expr("a.kind = 'ignored' OR b.kind = 'ignored' OR a.target_media = b.target_media")
    met = a.join(b, same & before & (F.col("b.source_start") < F.col("a.source_end")) & clash)
    return met.select(F.col("a.segment_id").alias("left_id"), F.col("b.segment_id").alias("right_id"))


def segment_blockers(segments: DataFrame, assets: DataFrame, maps: DataFrame, spans: DataFrame, bindings: DataFrame, media: DataFrame) -> DataFrame:
    """(segment_id, kind, blocker): the first reason why a segment cannot be used, null where it can.

    ``overlap`` comes first, then for all segments noAsset, noSource, notBound and otherSource; for content also
    noTarget, targetRole, noMap, and of its map missing, unconfirmed, mismatch, invalid, noEvidence, spanBlocked,
    spanLegacy, edges, ambiguous, review, blocked, legacy and identity.  Ambiguous spans that a reviewer took for
    replacements do not block.
    """
    conflicts = segment_conflicts(segments)
    clash = conflicts.select(F.col("left_id").alias("segment_id")).union(conflicts.select("right_id")).distinct().withColumn("_clash", F.lit(True))
    roles = media.select("media_id", "role")
    rows = segments.join(clash, "segment_id", "left").join(assets.select("asset_id", F.lit(True).alias("_asset")), "asset_id", "left")
    rows = rows.join(roles.select(F.col("media_id").alias("source_media"), F.col("role").alias("_source")), "source_media", "left")
    rows = rows.join(roles.select(F.col("media_id").alias("target_media"), F.col("role").alias("_target")), "target_media", "left")
    rows = rows.join(bindings.select("asset_id", F.col("source_media").alias("_bound")), "asset_id", "left")

    faulty = timemap.validate(spans.select("map_id", "span_index", "kind", "source_start", "source_end", "target_start", "target_end")).select("map_id").distinct().withColumn("_invalid", F.lit(True))
    first, last = F.min(F.struct("span_index", "source_start", "target_start")), F.max(F.struct("span_index", "source_end", "target_end"))
    unexplained = (F.col("kind") == "ambiguous") & ~F.coalesce(F.col("decision") == "replacement", F.lit(False))
    facts = spans.groupBy("map_id").agg(
        first.alias("_first"), last.alias("_last"), F.bool_or(F.col("level").isNull()).alias("_bare"), F.bool_or(F.col("level") == "blocked").alias("_stopped"), F.bool_or(F.col("level") == "legacy-unverified").alias("_old"), F.bool_or(unexplained).alias("_unclear")
    )
    named = {c: f"_m_{c}" for c in ("source_media", "target_media", "source_start", "source_end", "target_start", "target_end", "level", "state")}
    known = maps.select("map_id", *[F.col(c).alias(n) for c, n in named.items()], "identity_ok", F.lit(True).alias("_known"))
    rows = rows.join(known.join(facts, "map_id", "left").join(faulty, "map_id", "left"), "map_id", "left")

    differs = F.lit(False)
    for c in ("source_media", "target_media", "source_start", "source_end"):
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_m_{c}"))
    differs = differs | ~F.coalesce("target_start", F.lit(0)).eqNullSafe(F.col("_m_target_start"))
    off_edge = F.lit(False)
    for have, want in (("_first.source_start", "_m_source_start"), ("_last.source_end", "_m_source_end"), ("_first.target_start", "_m_target_start"), ("_last.target_end", "_m_target_end")):
        off_edge = off_edge | ~F.col(have).eqNullSafe(F.col(want))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reasons: list[tuple[Column, str]] = [
        (yes("_clash"), "overlap"), (~yes("_asset"), "noAsset"), (~F.col("_source").eqNullSafe(F.lit(SOURCE_ROLE)), "noSource"), (F.col("_bound").isNull(), "notBound"), (F.col("_bound") != F.col("source_media"), "otherSource"),
    ]
    of_content: list[tuple[Column, str]] = [
        (F.col("target_media").isNull(), "noTarget"), (~F.col("_target").eqNullSafe(F.lit(TARGET_ROLE)), "targetRole"), (F.col("map_id").isNull(), "noMap"), (~yes("_known"), "missing"), (~F.col("_m_state").eqNullSafe(F.lit("confirmed")), "unconfirmed"), (differs, "mismatch"),
        (yes("_invalid") | F.col("_first").isNull(), "invalid"), (yes("_bare"), "noEvidence"), (yes("_stopped"), "spanBlocked"), (yes("_old"), "spanLegacy"), (off_edge, "edges"), (yes("_unclear"), "ambiguous"),
        (F.col("_m_level") == "review", "review"), (F.col("_m_level") == "blocked", "blocked"), (F.col("_m_level") == "legacy-unverified", "legacy"), (~yes("identity_ok"), "identity"),
    ]
    content = F.col("kind") == "content"
    found = F.coalesce(*[F.when(c, r) for c, r in reasons], *[F.when(content & c, r) for c, r in of_content])
    return rows.select("segment_id", "kind", found.alias("blocker"))


@dataclass(frozen=True)
class Projection:
    """``entries`` (segment_id, target_media, asset_id, item_id, original_index, final_ms, enabled) are the mapped
    items, ``outcomes`` (asset_id, item_id, outcome) says of every item whether it is mapped, sourceOnly, ignored or
    unexpected, and ``ignored`` has a row for every item inside a usable ignored segment."""

    entries: DataFrame
    outcomes: DataFrame
    ignored: DataFrame


def project_items(segments: DataFrame, blockers: DataFrame, items: DataFrame, spans: DataFrame, disabled: DataFrame, adjustments: DataFrame, width: int = 86_400_000) -> Projection:
    """Items through the segments that nothing blocks.

    An item counts under its asset and its own id, since ids repeat among assets.  It may be in several segments; it is
    mapped if one maps it.  Ambiguous spans map nothing: as replacements they discard their items like sourceOnly
    spans, else their items count as unexpected.
    """
    usable = segments.join(blockers.filter("blocker IS NULL").select("segment_id"), "segment_id", "left_semi")
    content, left_out = usable.filter("kind = 'content'"), usable.filter("kind = 'ignored'")
    answers = timemap.lookup_spans(spans, ["map_id"]).select("map_id", F.col("kind").alias("span_kind"), *[F.col(c).alias(f"_{c}") for c in ("source_start", "source_end", "target_start", "target_end")], "decision", "lo", "hi")
    pieces = content.join(answers, "map_id").withColumns({"lo": F.greatest("lo", "source_start"), "hi": F.least("hi", "source_end")}).filter("lo < hi")
    pieces = pieces.select("asset_id", "segment_id", "target_media", F.col("span_kind").alias("kind"), "decision", *[F.col(f"_{c}").alias(c) for c in ("source_start", "source_end", "target_start", "target_end")], "lo", "hi")
    met = point_in_interval_join(items, pieces, ["asset_id"], "at_ms", "lo", "hi", width, "left", counted=True).withColumns(timemap.status_and_target(F.col("at_ms")))
    skip = left_out.select("asset_id", F.col("source_start").alias("lo"), F.col("source_end").alias("hi"), F.lit(True).alias("_skip"))
    ignored = point_in_interval_join(items.select("asset_id", "item_id", "at_ms"), skip, ["asset_id"], "at_ms", "lo", "hi", width, counted=True).select("asset_id", "item_id")

    off = disabled.select("item_id").distinct().withColumn("_off", F.lit(True))
    mapped = met.filter("status = 'mapped'").join(off, "item_id", "left").join(adjustments.select("item_id", "adjustment_ms"), "item_id", "left")
    final = F.col("target_ms") + F.coalesce("adjustment_ms", F.lit(0))
    entries = mapped.select("segment_id", "target_media", "asset_id", "item_id", "original_index", final.alias("final_ms"), (F.col("enabled") & F.col("_off").isNull()).alias("enabled"))

    rank = F.when(F.col("status") == "mapped", 3).when((F.col("status") == "sourceOnly") | ((F.col("status") == "ambiguous") & (F.col("decision") == "replacement")), 2).otherwise(0)
    seen = met.select("asset_id", "item_id", rank.alias("r")).union(ignored.select("asset_id", "item_id", F.lit(1).alias("r")))
    best = seen.groupBy("asset_id", "item_id").agg(F.max("r").alias("r"))
    outcome = F.when(F.col("r") == 3, "mapped").when(F.col("r") == 2, "sourceOnly").when(F.col("r") == 1, "ignored").otherwise("unexpected")
    return Projection(entries, best.select("asset_id", "item_id", outcome.alias("outcome")), ignored)


def target_groups(entries: DataFrame, media: DataFrame) -> DataFrame:
    """(target_media, entries, disabled, negative, overflow, first_ms, last_ms): what each target gets, and what of it
    lies before its beginning or behind its end."""
    on = F.col("enabled")
    late = on & (F.col("final_ms") >= F.col("duration_ms"))
    rows = entries.join(media.select(F.col("media_id").alias("target_media"), "duration_ms"), "target_media", "left")
    return rows.groupBy("target_media").agg(F.count_if(on).alias("entries"), F.count_if(~on).alias("disabled"), F.count_if(on & (F.col("final_ms") < 0)).alias("negative"), F.count_if(F.coalesce(late, F.lit(False))).alias("overflow"), F.min(F.when(on, F.col("final_ms"))).alias("first_ms"), F.max(F.when(on, F.col("final_ms"))).alias("last_ms"))


def in_order(entries: DataFrame) -> DataFrame:
    """Enabled entries with ``place``, from 1, in their target's order: final time, then original order."""
    from tidemark.operators.ordering import numbered

    rows = numbered(entries.filter("enabled"), ["target_media"], "final_ms", "original_index", "asset_id", "item_id", pos="place")
    return rows.withColumn("place", F.col("place") + 1)

"""Proposed matches of two media: accepting and revoking them, their state after edits, and their evidence when ranges move.

Tables: ``candidates`` (candidate_id, source_media, target_media, source_start, source_end, target_start, target_end,
state, map_id, blocked), where ``map_id`` is the confirmed map and ``blocked`` says that the proposal cannot be used;
``segments`` as in ``projection``; ``maps`` (map_id, candidate_id, state, revision, level); ``bindings`` (asset_id,
source_media), ``assets`` (asset_id) and ``media`` (media_id, role).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.projection import SOURCE_ROLE, TARGET_ROLE
from tidemark.session import cut


def segment_id(candidate: Column, asset: Column) -> Column:
    return F.concat(candidate, F.lit(":segment:"), asset)


def confirmed_map_id(candidate: Column, revision: Column) -> Column:
    return F.concat(candidate, F.lit(":confirmed:"), revision.cast("string"))


def acceptances(requests: DataFrame, candidates: DataFrame, segments: DataFrame, maps: DataFrame, bindings: DataFrame, assets: DataFrame, media: DataFrame, width: int = 600_000) -> DataFrame:
    """(candidate_id, asset_id, reason, map_id, segment_id, new): what becomes of every request (candidate_id, asset_id).

    A candidate is accepted with all its requested assets or not at all: ``reason`` is then the first of unknown,
    rejected, media, range, blocked (no usable map), noMap (accepted before, but its map is gone), noAsset, notBound,
    otherSource, taken (the segment's id stands for something else) and overlap (with a held segment of the asset that
    is ignored or has the same target, or with one of another candidate of the same requests that nothing else
    speaks against and that comes before by its id).
    Accepting again changes nothing: ``new`` is false for segments that are there.  A first acceptance confirms the
    next revision of the candidate's map.  Ranges meet in cells of ``width`` ms that both touch.
    """
    on = ["asset_id", "source_media", "_cell"]

    def in_cells(rows: DataFrame, start: str, end: str) -> DataFrame:
        return rows.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / width))))

    asked = requests.filter(F.trim("asset_id") != "").select("candidate_id", F.trim("asset_id").alias("asset_id")).distinct()
    c = candidates.select("candidate_id", "source_media", "target_media", "source_start", "source_end", "target_start", "state", F.col("map_id").alias("_map"), "blocked", F.lit(True).alias("_known"))
    rows = asked.join(c, "candidate_id", "left")
    for side, role in (("source_media", SOURCE_ROLE), ("target_media", TARGET_ROLE)):
        rows = rows.join(media.select(F.col("media_id").alias(side), (F.col("role") == role).alias(f"_{side}")), side, "left")
    held = maps.filter("state = 'confirmed'")
    rows = rows.join(held.select(F.col("map_id").alias("_map"), F.lit(True).alias("_held")), "_map", "left")
    last = held.groupBy("candidate_id").agg(F.max("revision").alias("_revision"))
    stopped = maps.filter("state = 'candidate'").groupBy("candidate_id").agg(F.bool_or(F.col("level") == "blocked").alias("_stopped"))
    rows = rows.join(last, "candidate_id", "left").join(stopped, "candidate_id", "left")
    rows = rows.join(assets.select("asset_id", F.lit(True).alias("_asset")), "asset_id", "left").join(bindings.select("asset_id", F.col("source_media").alias("_bound")), "asset_id", "left")
    map_ = F.when(F.coalesce("_held", F.lit(False)), F.col("_map")).otherwise(confirmed_map_id(F.col("candidate_id"), F.coalesce("_revision", F.lit(0)) + 1))
    rows = rows.withColumns({"map_id": map_, "segment_id": segment_id(F.col("candidate_id"), F.col("asset_id"))})

    own = segments.select("segment_id", *[F.col(x).alias(f"_s_{x}") for x in ("kind", "asset_id", "source_media", "target_media", "source_start", "source_end", "map_id")], F.lit(True).alias("_there"))
    rows = rows.join(own, "segment_id", "left")
    same = (F.col("_s_kind") == "content") & (F.col("_s_map_id") == F.col("map_id"))
    for x in ("asset_id", "source_media", "target_media", "source_start", "source_end"):
        same = same & F.col(f"_s_{x}").eqNullSafe(F.col(x))
    rows = rows.withColumns({"_there": F.coalesce("_there", F.lit(False)), "_same": F.coalesce(same, F.lit(False))})
    there, same = F.col("_there"), F.col("_same")

    others = segments.filter("asset_id IS NOT NULL AND source_media IS NOT NULL").select("asset_id", "source_media", F.col("segment_id").alias("_o"), F.col("kind").alias("_k"), F.col("target_media").alias("_t"), F.col("source_start").alias("_a"), F.col("source_end").alias("_b"))
    ranged = rows.select("candidate_id", "asset_id", "source_media", "target_media", "source_start", "source_end", "segment_id")
    crossing = (F.col("_a") < F.col("source_end")) & (F.col("source_start") < F.col("_b")) & ((F.col("_k") == "ignored") | F.col("_t").eqNullSafe(F.col("target_media")))
    met = in_cells(ranged, "source_start", "source_end").join(in_cells(others, "_a", "_b"), on).filter(crossing & (F.col("_o") != F.col("segment_id")))
    met = met.select("candidate_id", "asset_id").distinct()
    rows = rows.join(met.withColumn("_over", F.lit(True)), ["candidate_id", "asset_id"], "left")

    yes = lambda x: F.coalesce(F.col(x), F.lit(False))
    ordered = (F.col("source_start") >= 0) & (F.col("source_end") > F.col("source_start")) & (F.col("target_start") >= 0)
    reasons = [
        (~yes("_known"), "unknown"), (F.col("state") == "rejected", "rejected"), (~(yes("_source_media") & yes("_target_media")), "media"), (~F.coalesce(ordered, F.lit(False)), "range"), (yes("blocked") | yes("_stopped"), "blocked"),
        ((F.col("state") == "accepted") & ~yes("_held"), "noMap"), (~yes("_asset"), "noAsset"), (F.col("_bound").isNull(), "notBound"), (F.col("_bound") != F.col("source_media"), "otherSource"), (there & ~same, "taken"), (~there & yes("_over"), "overlap"),
    ]
    rank = F.coalesce(*[F.when(x, k) for k, (x, _) in enumerate(reasons)])
    names = F.array(*[F.lit(n) for _, n in reasons])
    first = rows.withColumn("_r", rank).groupBy("candidate_id").agg(F.min("_r").alias("_r"))
    rows = cut(rows.join(first, "candidate_id").withColumn("reason", F.get(names, F.col("_r"))))
    able = rows.filter("reason IS NULL").select("candidate_id", "asset_id", "source_media", "target_media", "source_start", "source_end")
    before = able.select("asset_id", "source_media", F.col("candidate_id").alias("_c"), F.col("target_media").alias("_t"), F.col("source_start").alias("_a"), F.col("source_end").alias("_b"), F.lit("content").alias("_k"))
    late = in_cells(able, "source_start", "source_end").join(in_cells(before, "_a", "_b"), on).filter(crossing & (F.col("_c") < F.col("candidate_id"))).select("candidate_id").distinct()
    out = rows.join(late.withColumn("_late", F.lit(True)), "candidate_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_late"), "overlap")))
    fine = F.col("reason").isNull()
    return out.select("candidate_id", "asset_id", "reason", F.when(fine, F.col("map_id")).alias("map_id"), F.when(fine, F.col("segment_id")).alias("segment_id"), (fine & ~there).alias("new"))


def accepted_segments(outcomes: DataFrame, candidates: DataFrame) -> DataFrame:
    """The segments that acceptances add."""
    c = candidates.select("candidate_id", "source_media", "target_media", "source_start", "source_end", "target_start")
    new = outcomes.filter("new").join(c, "candidate_id")
    return new.select("segment_id", F.lit("content").alias("kind"), "asset_id", "source_media", "target_media", "map_id", "source_start", "source_end", "target_start")


def revocations(requests: DataFrame, candidates: DataFrame, segments: DataFrame, maps: DataFrame, applied: DataFrame) -> DataFrame:
    """(candidate_id, reason, map_id): acceptances to take back; all segments of ``map_id`` go where ``reason`` is null.

    ``applied`` is (candidate_id, segment_id), what a candidate names as its segments.  Refused: unknown, notAccepted,
    map (gone, not confirmed or another candidate's), shared (another accepted candidate has the map) and segment (a
    named segment is gone, ignored or of another map).
    """
    c = candidates.select("candidate_id", "state", F.col("map_id").alias("_map"), F.lit(True).alias("_known"))
    rows = requests.select("candidate_id").distinct().join(c, "candidate_id", "left")
    held = maps.filter("state = 'confirmed'").select(F.col("map_id").alias("_map"), F.col("candidate_id").alias("_of"))
    users = candidates.filter("state = 'accepted' AND map_id IS NOT NULL").groupBy(F.col("map_id").alias("_map")).agg(F.count(F.lit(1)).alias("_users"))
    own = segments.select("segment_id", F.col("kind").alias("_k"), F.col("map_id").alias("_m"))
    named = applied.join(own, "segment_id", "left").join(c.select("candidate_id", "_map"), "candidate_id", "left")
    wrong = named.groupBy("candidate_id").agg(F.bool_or(~(F.col("_k").eqNullSafe(F.lit("content")) & F.col("_m").eqNullSafe(F.col("_map")))).alias("_wrong"))
    rows = rows.join(held, "_map", "left").join(users, "_map", "left").join(wrong, "candidate_id", "left")
    yes = lambda x: F.coalesce(F.col(x), F.lit(False))
    reason = F.when(~yes("_known"), "unknown").when(F.col("state") != "accepted", "notAccepted").when(~F.col("_of").eqNullSafe(F.col("candidate_id")), "map").when(F.col("_users") > 1, "shared").when(yes("_wrong"), "segment")
    return rows.select("candidate_id", reason.alias("reason"), F.when(reason.isNull(), F.col("_map")).alias("map_id"))


def without_revoked(segments: DataFrame, outcomes: DataFrame) -> DataFrame:
    return segments.join(outcomes.filter("reason IS NULL").select("map_id"), "map_id", "left_anti").select(*segments.columns)


def reconciled(candidates: DataFrame, segments: DataFrame, bindings: DataFrame, assets: DataFrame, media: DataFrame, applied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, applied) as they are after edits elsewhere.

    Candidates whose media are gone go.  A named segment counts if it is there as content under the candidate's own
    id, media and confirmed map, and its asset is still bound to the source.  With one left a candidate is accepted;
    else it is pending if its source has an asset and its proposal is not blocked, and blocked if not, and its map is
    no longer confirmed.  Rejected ones stay rejected.
    """
    kept = candidates
    for side in ("source_media", "target_media"):
        kept = kept.join(media.select(F.col("media_id").alias(side)), side, "left_semi")
    live = bindings.join(assets.select("asset_id"), "asset_id", "left_semi")
    own = segments.filter("kind = 'content'").select("segment_id", "asset_id", *[F.col(x).alias(f"_{x}") for x in ("source_media", "target_media", "map_id")]).join(live.select("asset_id", F.col("source_media").alias("_bound")), "asset_id")
    named = applied.join(kept.select("candidate_id", "source_media", "target_media", "map_id"), "candidate_id").join(own, "segment_id")
    good = (F.col("_bound") == F.col("source_media")) & (F.col("segment_id") == segment_id(F.col("candidate_id"), F.col("asset_id")))
    for x in ("source_media", "target_media", "map_id"):
        good = good & (F.col(f"_{x}") == F.col(x))
    named = named.filter(good).select("candidate_id", "segment_id")
    any_ = named.select("candidate_id", F.lit(True).alias("_applied")).distinct()
    sources = live.select("source_media", F.lit(True).alias("_asset")).distinct()
    rows = kept.join(any_, "candidate_id", "left").join(sources, "source_media", "left")
    yes = lambda x: F.coalesce(F.col(x), F.lit(False))
    state = F.when(F.col("state") == "rejected", "rejected").when(yes("_applied"), "accepted").when(yes("_asset") & ~yes("blocked"), "pending").otherwise("blocked")
    out = rows.withColumn("_state", state).withColumns({"state": F.col("_state"), "map_id": F.when(F.col("_state") == "accepted", F.col("map_id"))}).select(*candidates.columns)
    return out, named.join(out.filter("state = 'accepted'").select("candidate_id"), "candidate_id", "left_semi")


def shift_of(old_start: Column, old_end: Column, new_start: Column, new_end: Column) -> Column:
    """How far a range was moved as a whole; 0 where its length changed or nothing was said."""
    moved = new_start - old_start
    return F.when(new_end - old_end == moved, moved).otherwise(F.lit(0)).cast("long")


def moved_anchors(anchors: DataFrame, shifts: DataFrame, by: str = "candidate_id") -> DataFrame:
    """Anchors (by, source_ms, target_ms) moved by (by, source_shift, target_shift)."""
    rows = anchors.join(shifts, by, "left")
    move = {f"{side}_ms": F.col(f"{side}_ms") + F.coalesce(f"{side}_shift", F.lit(0)) for side in ("source", "target")}
    return rows.withColumns(move).select(*anchors.columns)


def moved_samples(samples: DataFrame, shifts: DataFrame, by: str = "candidate_id") -> DataFrame:
    """Samples of the evidence (by, axis, start_ms, end_ms, counterpart_ms, offset_ms) moved along with the ranges."""
    s, t = (F.coalesce(f"{x}_shift", F.lit(0)) for x in ("source", "target"))
    own, other = F.when(F.col("axis") == "source", s).otherwise(t), F.when(F.col("axis") == "source", t).otherwise(s)
    rows = samples.join(shifts, by, "left")
    return rows.withColumns({"start_ms": F.col("start_ms") + own, "end_ms": F.col("end_ms") + own, "counterpart_ms": F.col("counterpart_ms") + other, "offset_ms": F.col("offset_ms") + t - s}).select(*samples.columns)


def clipped(anchors: DataFrame, cuts: DataFrame, samples: DataFrame, ranges: DataFrame, by: str = "candidate_id") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Evidence inside new ranges (by, source_start, source_end, target_start, target_end), and how much was left out.

    Anchors must be inside on both axes, cuts (by, at_ms, range_start, range_end) on the source, with their ranges cut
    down but never past the cut itself; samples are cut down to their axis' range.
    """
    names = ["source_start", "source_end", "target_start", "target_end"]
    r = ranges.select(by, *[F.col(c).alias(f"_{c}") for c in names])
    c = F.col
    inside = anchors.join(r, by).filter((c("source_ms") >= c("_source_start")) & (c("source_ms") < c("_source_end")) & (c("target_ms") >= c("_target_start")) & (c("target_ms") < c("_target_end"))).select(*anchors.columns)
    held = cuts.join(r, by).filter((c("at_ms") >= c("_source_start")) & (c("at_ms") < c("_source_end")))
    # Null ranges stay null: greatest and least would skip them.
    start = F.when(c("range_start").isNotNull(), F.least("at_ms", F.greatest("_source_start", "range_start")))
    end = F.when(c("range_end").isNotNull(), F.greatest("at_ms", F.least("_source_end", "range_end")))
    kept = held.withColumns({"range_start": start, "range_end": end}).select(*cuts.columns)
    a = F.when(c("axis") == "source", c("_source_start")).otherwise(c("_target_start"))
    b = F.when(c("axis") == "source", c("_source_end")).otherwise(c("_target_end"))
    part = samples.join(r, by).filter((c("end_ms") > a) & (c("start_ms") < b)).withColumns({"start_ms": F.greatest(a, "start_ms"), "end_ms": F.least(b, "end_ms")}).select(*samples.columns)
    n = lambda rows, name: rows.groupBy(by).agg(F.count(F.lit(1)).alias(name))
    whole = n(anchors.select(by).unionByName(cuts.select(by)), "_all").join(n(inside.select(by).unionByName(kept.select(by)), "_in"), by, "left")
    return inside, kept, part, whole.select(by, (c("_all") - F.coalesce("_in", F.lit(0))).alias("removed"))


def anchors_applied(proposed: DataFrame, held: DataFrame, by: str, tolerance: int) -> DataFrame:
    """``proposed`` anchors with whether one is held within ``tolerance`` on both axes."""
    p = proposed.withColumn("_id", F.monotonically_increasing_id())
    cells = F.explode(F.array(*[F.floor(F.col("source_ms") / (tolerance + 1)) + k for k in (-1, 0, 1)]))
    h = held.select(by, F.col("source_ms").alias("_s"), F.col("target_ms").alias("_t"), cells.alias("_cell"))
    met = p.withColumn("_cell", F.floor(F.col("source_ms") / (tolerance + 1))).join(h, [by, "_cell"], "left")
    near = F.coalesce((F.abs(F.col("source_ms") - F.col("_s")) <= tolerance) & (F.abs(F.col("target_ms") - F.col("_t")) <= tolerance), F.lit(False))
    return met.groupBy("_id", *proposed.columns).agg(F.bool_or(near).alias("applied")).drop("_id")

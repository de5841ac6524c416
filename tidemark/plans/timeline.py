"""Queries over the event timeline: maps, clips, cuts, visibility, density."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import intervals, timeline, timemap
from tidemark.plans import bindings as B
from tidemark.plans.collect import collector
from tidemark.session import table

QUERIES, SQL, query = collector()

_PROJECTED = f"""(SELECT e.event_id, e.event_type, e.t_ms, s.kind, s.s0, s.s1, s.t0, s.t1,
  CASE WHEN s.kind = 'matched' THEN 'mapped' WHEN s.kind IS NULL THEN 'unmapped' ELSE s.kind END AS status,
  CASE WHEN s.kind = 'matched' THEN least(s.t1 - 1, s.t0 + CAST((2 * CAST(e.t_ms - s.s0 AS HUGEINT) * (s.t1 - s.t0) + (s.s1 - s.s0)) // (2 * (s.s1 - s.s0)) AS BIGINT)) END AS target_ms
  FROM {B.E_SQL} e LEFT JOIN {B.SPANS_SQL} s ON s.map_id = e.event_type AND s.s1 > s.s0 AND e.t_ms >= s.s0 AND e.t_ms < s.s1)"""


def _projected(spark: SparkSession, d: str) -> DataFrame:
    return timemap.project(B.events(spark, d), B.spans(spark), "event_type")


@query(f"SELECT event_id, event_type, t_ms, status, target_ms FROM {_PROJECTED}")
def timemap_events(spark, d):
    return _projected(spark, d).select("event_id", "event_type", "t_ms", "status", "target_ms")


@query(f"SELECT event_type, status, count(*) AS n, min(target_ms) AS first_ms, max(target_ms) AS last_ms FROM {_PROJECTED} GROUP BY ALL")
def timemap_project(spark, d):
    return _projected(spark, d).groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("n"), F.min("target_ms").alias("first_ms"), F.max("target_ms").alias("last_ms"))


@query(f"SELECT status, count(*) AS n FROM {_PROJECTED} GROUP BY status")
def timemap_status_counts(spark, d):
    return _projected(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_KINDS = ["matched", "matched", "sourceOnly", "targetOnly", "ambiguous", "matched", "wrong"]
#: An order's lines as the spans of a map, one behind the other but for some that are torn, empty or of no kind.
_LINE_SPANS = f"""(SELECT l_orderkey AS map_id, i AS span_index, kind, s0, s1, t0, t1 FROM (SELECT *, [{', '.join(f"'{k}'" for k in _KINDS)}][l_partkey % 7 + 1] AS kind, (i - 1) * 100 + CASE WHEN l_suppkey % 9 = 0 THEN 7 WHEN l_suppkey % 23 = 0 THEN -500 ELSE 0 END AS s0, i * 100 - CASE WHEN l_partkey % 13 = 0 THEN 100 ELSE 0 END AS s1, (i - 1) * 90 AS t0, i * 90 + CASE WHEN l_partkey % 19 = 0 THEN 4 ELSE 0 END AS t1
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem)))"""


def _line_spans(spark, d):
    i = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = table(spark, d, "lineitem").withColumn("i", i)
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("l_partkey") % 7 + 1).cast("int"))
    s0 = (F.col("i") - 1) * 100 + F.when(F.col("l_suppkey") % 9 == 0, 7).when(F.col("l_suppkey") % 23 == 0, -500).otherwise(0)
    s1 = F.col("i") * 100 - F.when(F.col("l_partkey") % 13 == 0, 100).otherwise(0)
    t1 = F.col("i") * 90 + F.when(F.col("l_partkey") % 19 == 0, 4).otherwise(0)
    return rows.select(F.col("l_orderkey").alias("map_id"), F.col("i").alias("span_index"), kind.alias("kind"), s0.cast("long").alias("source_start"), s1.cast("long").alias("source_end"), ((F.col("i") - 1) * 90).cast("long").alias("target_start"), t1.cast("long").alias("target_end"))


@query(f"""WITH b AS (SELECT *, s0 >= 0 AND s1 >= 0 AND t0 >= 0 AND t1 >= 0 AS good, s1 - s0 AS ds, t1 - t0 AS dt FROM {_LINE_SPANS}), c AS (SELECT *, good AND ds >= 0 AND dt >= 0 AS fit FROM b),
l AS (SELECT *, lag(s0) OVER w AS ps0, lag(s1) OVER w AS ps, lag(t0) OVER w AS pt0, lag(t1) OVER w AS pt, fit AND coalesce(lag(fit) OVER w, FALSE) AS two,
CASE kind WHEN 'matched' THEN ds > 0 AND dt > 0 WHEN 'sourceOnly' THEN ds > 0 AND dt = 0 WHEN 'targetOnly' THEN ds = 0 AND dt > 0 WHEN 'ambiguous' THEN ds > 0 OR dt > 0 ELSE FALSE END AS shape FROM c WINDOW w AS (PARTITION BY map_id ORDER BY span_index)),
i AS (SELECT map_id, span_index, CASE WHEN NOT good THEN 'invalidMilliseconds' WHEN NOT fit THEN 'invalidRange' WHEN kind = 'ambiguous' THEN 'emptyAmbiguousSpan' ELSE 'invalidKindShape' END AS issue FROM l WHERE NOT good OR NOT fit OR NOT shape
UNION ALL SELECT map_id, span_index, 'outOfOrder' FROM l WHERE two AND (s0 < ps0 OR t0 < pt0)
UNION ALL SELECT map_id, span_index, CASE WHEN ps < s0 THEN 'sourceDiscontinuity' ELSE 'sourceOverlap' END FROM l WHERE two AND ps <> s0
UNION ALL SELECT map_id, span_index, CASE WHEN pt < t0 THEN 'targetDiscontinuity' ELSE 'targetOverlap' END FROM l WHERE two AND pt <> t0)
SELECT map_id, CAST(span_index AS INTEGER) AS span_index, issue FROM i""")
def timemap_validate(spark, d):
    return timemap.validate(_line_spans(spark, d))


@query(f"SELECT map_id, CAST(span_index AS INTEGER) AS span_index, CASE kind WHEN 'sourceOnly' THEN 'targetOnly' WHEN 'targetOnly' THEN 'sourceOnly' ELSE kind END AS kind, t0 AS source_start, t1 AS source_end, s0 AS target_start, s1 AS target_end FROM {_LINE_SPANS}")
def timemap_inverse(spark, d):
    return timemap.inverse(_line_spans(spark, d))


@query(f"SELECT e.event_id, e.t_ms + coalesce((SELECT sum(gap_ms) FROM {B.MARKERS_SQL} m WHERE m.at_ms <= e.t_ms), 0)::BIGINT AS mapped_ms FROM {B.E_SQL} e")
def cut_map_events(spark, d):
    return timeline.apply_cuts(B.events(spark, d), B.markers(spark), "t_ms", "mapped_ms").select("event_id", "mapped_ms")


@query(f"""SELECT c.clip_id, e.event_id, c.line_start + (e.t_ms - c.in_ms) + c.local_ms + coalesce((SELECT sum(gap_ms) FROM {B.MARKERS_SQL} m WHERE m.at_ms <= c.line_start + (e.t_ms - c.in_ms) + c.local_ms), 0)::BIGINT AS final_ms
FROM {B.E_SQL} e JOIN {B.CLIPS_SQL} c ON c.asset_id = e.event_type AND e.t_ms >= c.in_ms AND e.t_ms < c.out_ms WHERE c.enabled""")
def clip_resolve(spark, d):
    placed = timeline.resolve_clips(B.events(spark, d), B.clips(spark), "event_type", "t_ms")
    return timeline.apply_cuts(placed, B.markers(spark), "line_ms", "final_ms").select("clip_id", "event_id", "final_ms")


@query(f"""WITH c AS (SELECT t_ms // {B.DAY} AS day, count(*) AS n FROM {B.E_SQL} GROUP BY 1), r AS (SELECT min(day) AS a, max(day) AS b FROM c)
SELECT g.day, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(generate_series(a, b)) AS day FROM r) g LEFT JOIN c ON c.day = g.day""")
def density_zero_filled(spark, d):
    return timeline.density(B.events(spark, d), "t_ms", B.DAY).select(F.col("bucket").alias("day"), "n")


@query(f"""SELECT event_id, t_ms FROM (SELECT event_id, t_ms, row_number() OVER (ORDER BY t_ms, event_id) AS rn FROM {B.E_SQL}
WHERE t_ms <= {30 * B.DAY} AND t_ms + CASE WHEN event_id % 6 IN (4, 5) THEN 4500000 ELSE 8000000 END >= {30 * B.DAY}) WHERE rn <= 80""")
def visible_at(spark, d):
    live = F.when((F.col("event_id") % 6).isin(4, 5), 4_500_000).otherwise(8_000_000)
    return timeline.visible_at(B.events(spark, d), "t_ms", live, 30 * B.DAY, ["t_ms", "event_id"], 80).select("event_id", "t_ms")


@query(f"""SELECT count(*) AS n, count(*) FILTER (WHERE t_ms < 0) AS n_negative, min(t_ms) AS first_ms, max(t_ms) AS last_ms, count(DISTINCT t_ms // 60000) AS minutes,
count(DISTINCT user_id) AS users, count(*) - count(DISTINCT user_id) AS repeats FROM {B.E_SQL}""")
def export_summary(spark, d):
    e = B.events(spark, d)
    return e.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("t_ms") < 0).alias("n_negative"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"),
        F.count_distinct(F.floor(F.col("t_ms") / 60000)).alias("minutes"), F.count_distinct("user_id").alias("users"), (F.count(F.lit(1)) - F.count_distinct("user_id")).alias("repeats"),
    )


_SHIP = "(SELECT l_orderkey, l_linenumber, l_partkey, epoch_ms(l_shipdate) // 86400000 AS s, epoch_ms(l_shipdate) // 86400000 + CAST(l_quantity AS BIGINT) AS e FROM lineitem)"


def _ship(spark, d):
    day = F.floor(F.unix_millis(F.col("l_shipdate").cast("timestamp")) / 86_400_000)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"))


_MERGED = f"""(WITH p AS (SELECT l_partkey, s, e, max(e) OVER (PARTITION BY l_partkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {_SHIP}),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_partkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM p)
SELECT l_partkey, min(s) AS s, max(e) AS e FROM g GROUP BY l_partkey, run)"""


@query(f"SELECT l_partkey, s, e FROM {_MERGED}")
def interval_merge(spark, d):
    return intervals.merge_intervals(_ship(spark, d), ["l_partkey"], "s", "e")


@query(f"SELECT l_partkey, e AS gap_start, nx AS gap_end FROM (SELECT *, lead(s) OVER (PARTITION BY l_partkey ORDER BY s) AS nx FROM {_MERGED}) WHERE nx IS NOT NULL")
def interval_gaps(spark, d):
    return intervals.interval_gaps(_ship(spark, d), ["l_partkey"], "s", "e")


@query(f"""WITH w AS (SELECT p_partkey AS l_partkey, 9000 AS a, 9000 + p_partkey % 4 * 900 AS b FROM part), h AS (SELECT l_partkey, a, b, greatest(s, a) AS s, least(e, b) AS e FROM w LEFT JOIN {_MERGED} m USING (l_partkey) WHERE a < b),
i AS (SELECT * FROM h WHERE s < e), p AS (SELECT l_partkey, coalesce(max(e) OVER (PARTITION BY l_partkey ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a) AS gap_start, s AS gap_end FROM i UNION ALL SELECT l_partkey, coalesce(max(e), max(a)), max(b) FROM (SELECT w.l_partkey, w.a, w.b, i.e FROM w LEFT JOIN i ON i.l_partkey = w.l_partkey WHERE w.a < w.b) GROUP BY 1)
SELECT l_partkey, gap_start::BIGINT AS gap_start, gap_end::BIGINT AS gap_end FROM p WHERE gap_start < gap_end""")
def interval_gaps_whole(spark, d):
    """What of a part's own range is not covered, before, between and behind its intervals."""
    begin = F.lit(9000).cast("long")
    whole = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), begin.alias("begin"), (begin + F.col("p_partkey") % 4 * 900).alias("finish"))
    return intervals.interval_gaps(_ship(spark, d), ["l_partkey"], "s", "e", whole)


@query(f"""WITH x AS (SELECT l_partkey, s AS pos, 1 AS d FROM {_SHIP} UNION ALL SELECT l_partkey, e, -1 FROM {_SHIP}), y AS (SELECT l_partkey, pos, sum(d) AS d FROM x GROUP BY ALL HAVING sum(d) <> 0),
z AS (SELECT l_partkey, pos AS band_start, lead(pos) OVER w AS band_end, CAST(sum(d) OVER w AS BIGINT) AS depth FROM y WINDOW w AS (PARTITION BY l_partkey ORDER BY pos))
SELECT * FROM z WHERE depth > 0 AND band_end IS NOT NULL""")
def coverage_bands(spark, d):
    return intervals.coverage_bands(_ship(spark, d), ["l_partkey"], "s", "e")


@query(f"""SELECT a.l_partkey, a.k AS a, b.k AS b FROM (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS k, s, e FROM {_SHIP}) a JOIN (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS k, s, e FROM {_SHIP}) b
ON a.l_partkey = b.l_partkey AND a.k < b.k AND a.s < b.e AND b.s < a.e""")
def segment_overlaps(spark, d):
    rows = _ship(spark, d).withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return intervals.overlapping_pairs(rows, "k", ["l_partkey"], "s", "e", 64)


@query(f"""SELECT event_id, last_purchase FROM (SELECT a.event_id, (SELECT max(t_ms) FROM {B.E_SQL} b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.t_ms <= a.t_ms) AS last_purchase FROM {B.E_SQL} a WHERE a.event_type = 'click')""")
def asof_before(spark, d):
    e = B.events(spark, d)
    bought = e.filter("event_type = 'purchase'").select("user_id", "t_ms", F.col("t_ms").alias("purchase"))
    return intervals.nearest_before(e.filter("event_type = 'click'").select("event_id", "user_id", "t_ms"), bought, ["user_id"], "t_ms", "purchase").select("event_id", "last_purchase")


@query(f"SELECT DISTINCT a.event_id FROM {B.E_SQL} a JOIN {B.E_SQL} b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND abs(a.t_ms - b.t_ms) <= 45000000 WHERE a.event_type = 'view'")
def hint_band_support(spark, d):
    e = B.events(spark, d)
    cuts = e.filter("event_type = 'purchase'").select("user_id", F.col("t_ms").alias("at"))
    return intervals.band_semi_join(e.filter("event_type = 'view'"), cuts, ["user_id"], "t_ms", "at", 45_000_000).select("event_id")


@query(f"""SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, min(t_ms) AS first_ms, max(t_ms) AS last_ms FROM (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY t_ms, event_id ROWS UNBOUNDED PRECEDING) AS run FROM
(SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS ch FROM {B.E_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, event_id))) GROUP BY ALL""")
def rle_segments(spark, d):
    e = intervals.runs(B.events(spark, d), ["user_id"], ["t_ms", "event_id"], F.col("event_type"))
    return e.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"))


@query(f"""SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY t_ms, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))[(count(*) OVER (PARTITION BY user_id ORDER BY t_ms, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) // 2 + 1] AS median5 FROM {B.E_SQL}""")
def rolling_median5(spark, d):
    w = W.partitionBy("user_id").orderBy("t_ms", "event_id").rowsBetween(-2, 2)
    values = F.array_sort(F.collect_list("value").over(w))
    return B.events(spark, d).withColumn("v", values).select("event_id", F.get("v", F.floor(F.size("v") / 2).cast("int")).alias("median5"))


@query(f"""SELECT user_id, at_ms, gap_ms FROM (SELECT user_id, t_ms AS at_ms, nx - t_ms AS gap_ms, row_number() OVER (PARTITION BY user_id ORDER BY nx - t_ms DESC, t_ms) AS rn FROM
(SELECT user_id, t_ms, lead(t_ms) OVER (PARTITION BY user_id ORDER BY t_ms, event_id) AS nx FROM {B.E_SQL}) WHERE nx IS NOT NULL) WHERE rn = 1""")
def largest_gap_boundary(spark, d):
    w = W.partitionBy("user_id").orderBy("t_ms", "event_id")
    gaps = B.events(spark, d).withColumn("gap_ms", F.lead("t_ms").over(w) - F.col("t_ms")).filter("gap_ms IS NOT NULL")
    return gaps.groupBy("user_id").agg(F.min_by(F.struct(F.col("t_ms").alias("at_ms"), "gap_ms"), F.struct(-F.col("gap_ms"), "t_ms")).alias("g")).select("user_id", "g.*")


@query(f"""SELECT user_id, t_ms AS at_ms, t_ms - pv - 3600000 AS gap_ms, CASE WHEN t_ms - pv > 7200000 THEN 0.72::DOUBLE ELSE 0.35::DOUBLE END AS confidence FROM
(SELECT user_id, t_ms, lag(t_ms) OVER (PARTITION BY user_id ORDER BY t_ms, event_id) AS pv FROM {B.E_SQL} WHERE event_type = 'purchase') WHERE t_ms - pv > 3600000""")
def anchor_gap_cuts(spark, d):
    w = W.partitionBy("user_id").orderBy("t_ms", "event_id")
    e = B.events(spark, d).filter("event_type = 'purchase'").withColumn("since", F.col("t_ms") - F.lag("t_ms").over(w)).filter("since > 3600000")
    return e.select("user_id", F.col("t_ms").alias("at_ms"), (F.col("since") - 3_600_000).alias("gap_ms"), F.when(F.col("since") > 7_200_000, 0.72).otherwise(0.35).alias("confidence"))


@query(f"""SELECT user_id, CAST(sum(CASE WHEN g BETWEEN 0 AND 600000000 THEN g ELSE 0 END) AS BIGINT) AS credited_ms, count(*) FILTER (WHERE g > 600000000 OR g IS NULL) AS sessions FROM
(SELECT user_id, t_ms - lag(t_ms) OVER (PARTITION BY user_id ORDER BY t_ms, event_id) AS g FROM {B.E_SQL}) GROUP BY user_id""")
def playback_coverage(spark, d):
    return timeline.playback_coverage(B.events(spark, d), ["user_id"], ["t_ms", "event_id"], "t_ms", 600_000_000)


@query("""SELECT o_custkey, o_orderkey, CAST(coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ms FROM orders""")
def segment_append(spark, d):
    rows = table(spark, d, "orders").withColumn("length", F.floor("o_totalprice"))
    return timeline.append_offsets(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "length", "offset_ms").select("o_custkey", "o_orderkey", "offset_ms")

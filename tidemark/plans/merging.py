"""Queries over windows, splits, cuts and merged parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import batch, merging
from tidemark.operators.lookup import bottom_k
from tidemark.plans import bindings as B
from tidemark.plans.collect import collector
from tidemark.session import cut, table

QUERIES, SQL, query = collector()
_BY = f"(SELECT *, user_id % 4 AS m FROM {B.E_SQL})"


@query(f"""WITH w AS (SELECT *, min(t_ms) OVER (PARTITION BY user_id) AS a, max(t_ms) OVER (PARTITION BY user_id) AS b FROM {_BY}),
x AS (SELECT *, CASE m WHEN 0 THEN 0 WHEN 1 THEN greatest(0, b - 600000000) WHEN 2 THEN 500000000 ELSE a END AS s, CASE m WHEN 0 THEN 600000000 WHEN 2 THEN 900000000 ELSE b + 1 END AS e FROM w)
SELECT event_id, CAST(t_ms - s AS BIGINT) AS since_ms FROM x WHERE t_ms >= s AND t_ms < e""")
def segment_windows(spark, d):
    m = F.col("user_id") % 4
    mode = F.when(m == 0, "prefix").when(m == 1, "suffix").when(m == 2, "range").otherwise("full")
    first = F.when(m == 2, F.lit(500_000_000)).otherwise(F.lit(600_000_000))
    return merging.windowed(B.events(spark, d), ["user_id"], "t_ms", mode, first, F.lit(900_000_000), "since_ms").select("event_id", "since_ms")


_BOUNDS = f"""(WITH r AS (SELECT user_id, t_ms, lead(t_ms) OVER (PARTITION BY user_id ORDER BY t_ms) AS nx FROM {B.E_SQL}), e AS (SELECT user_id, min(t_ms) AS a, max(t_ms) AS b, 2 + user_id % 3 AS n FROM {B.E_SQL} GROUP BY user_id),
g AS (SELECT e.*, (t_ms + nx) / 2 AS m, nx - t_ms AS gap, t_ms AS l, greatest(1, b - a) / n AS len FROM r JOIN e USING (user_id) WHERE nx - t_ms >= 60000), p AS (SELECT *, CAST(round((m - a) / len) AS INTEGER) AS place FROM g),
f AS (SELECT user_id, place, arg_max(m, (gap - abs(m - a - len * place) * 0.2::DOUBLE, -l)) AS m FROM p WHERE place >= 1 AND place < n AND abs(m - a - len * place) <= len * 0.35::DOUBLE GROUP BY ALL),
q AS (SELECT e.*, unnest(range(1, n))::INTEGER AS place FROM e)
SELECT q.user_id, q.place, CAST(floor(coalesce(m, a + greatest(1, b - a) / n * q.place) + 0.5) AS BIGINT) AS boundary_ms, m IS NOT NULL AS found FROM q LEFT JOIN f USING (user_id, place))"""


def _bounds(spark, d):
    e = B.events(spark, d).withColumn("n", 2 + F.col("user_id") % 3)
    return merging.inferred_boundaries(e, ["user_id"], "t_ms", "n")


@query(f"SELECT * FROM {_BOUNDS}")
def range_boundaries(spark, d):
    return _bounds(spark, d)


@query(f"SELECT user_id, CAST(part AS BIGINT) AS part, count(*) AS n, min(t_ms) AS first_ms FROM (SELECT e.user_id, e.t_ms, (SELECT count(*) FROM {_BOUNDS} b WHERE b.user_id = e.user_id AND b.boundary_ms <= e.t_ms) AS part FROM {B.E_SQL} e) GROUP BY ALL")
def range_split(spark, d):
    parts = merging.split_at_boundaries(B.events(spark, d), _bounds(spark, d), ["user_id"], "t_ms")
    return parts.groupBy("user_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("t_ms").alias("first_ms"))


@query(f"""SELECT count(*) FILTER (WHERE gap > 0) AS affected_entries, count(DISTINCT user_id) FILTER (WHERE gap > 0) AS affected_episodes, 4::BIGINT AS markers, (SELECT CAST(sum(gap_ms) AS BIGINT) FROM {B.MARKERS_SQL}) AS total_gap_ms FROM
(SELECT user_id, coalesce((SELECT sum(gap_ms) FROM {B.MARKERS_SQL} m WHERE m.at_ms <= e.t_ms), 0) AS gap FROM {B.E_SQL} e)""")
def compensation_summary(spark, d):
    from tidemark.operators.timeline import apply_cuts

    moved = apply_cuts(B.events(spark, d), B.markers(spark), "t_ms", "mapped_ms").withColumn("hit", F.col("mapped_ms") > F.col("t_ms"))
    per = moved.agg(F.count_if("hit").alias("affected_entries"), F.count_distinct(F.when(F.col("hit"), F.col("user_id"))).alias("affected_episodes"))
    return per.crossJoin(F.broadcast(B.markers(spark).agg(F.count(F.lit(1)).alias("markers"), F.sum("gap_ms").alias("total_gap_ms"))))


_M = f"(SELECT user_id, t_ms AS s, t_ms + CASE WHEN event_id % 5 = 0 THEN 90000 ELSE event_id % 7 * 1000 END AS t, round(event_id % 30 / 100.0::DOUBLE, 2) AS dist FROM {B.E_SQL})"


def _matches(spark, d):
    shift = F.when(F.col("event_id") % 5 == 0, F.lit(90_000)).otherwise(F.col("event_id") % 7 * 1000)
    return B.events(spark, d).select("user_id", F.col("t_ms").alias("s"), (F.col("t_ms") + shift).alias("t"), F.round(F.col("event_id") % 30 / 100, 2).alias("dist"))


@query(f"""SELECT user_id, ps AS range_start, s AS range_end, g AS gap_ms, round(greatest(0.1, least(0.95, 1 - (pd + dist) / 0.36::DOUBLE))::DOUBLE, 6) AS confidence FROM (SELECT user_id, s, dist, lag(s) OVER w AS ps, lag(dist) OVER w AS pd, (t - lag(t) OVER w) - (s - lag(s) OVER w) AS g FROM {_M} WINDOW w AS (PARTITION BY user_id ORDER BY s, t)) WHERE g >= 1000""")
def match_gap_cuts(spark, d):
    return merging.cuts_from_matches(_matches(spark, d), ["user_id"], "s", "t", "dist", 1000)


@query(f"""WITH o AS (SELECT user_id, t_ms, CAST(floor((event_id // 40 % 6 * 3100) / 500.0::DOUBLE + 0.5) AS BIGINT) * 500 AS o, event_id % 30 / 100.0::DOUBLE AS dist FROM {B.E_SQL}),
c AS (SELECT *, CASE WHEN lag(o) OVER w = o THEN 0 ELSE 1 END AS ch FROM o WINDOW w AS (PARTITION BY user_id ORDER BY t_ms)), r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS run FROM c),
i AS (SELECT user_id, run, o, min(t_ms) AS a, max(t_ms) AS b, count(*) AS n, avg(dist) AS dd FROM r GROUP BY ALL), l AS (SELECT *, lag(o) OVER w AS po, lag(b) OVER w AS pb FROM i WINDOW w AS (PARTITION BY user_id ORDER BY a))
SELECT user_id, CAST(floor((pb + a) / 2 + 0.5) AS BIGINT) AS at_ms, o - po AS gap_ms, n AS support, round(greatest(0.1, least(0.98, 0.45 + least(1, n / 5) * 0.35 + greatest(0, least(1, 1 - dd / 0.18)) * 0.15))::DOUBLE, 6) AS confidence FROM l WHERE o - po >= 1000 AND greatest(500, b - a + 500) >= 10000""")
def change_points(spark, d):
    rows = B.events(spark, d).select("user_id", "t_ms", (F.floor(F.col("event_id") / 40) % 6 * 3100).alias("o"), (F.col("event_id") % 30 / 100).alias("dist"))
    return merging.change_points(rows, ["user_id"], "t_ms", "o", "dist", 500, 1000)


@query(f"SELECT event_id FROM (SELECT event_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM {B.E_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, event_id)) WHERE i % 8 = 0 OR i = n - 1")
def every_nth(spark, d):
    return merging.every_nth(B.events(spark, d), ["user_id"], ["t_ms", "event_id"], 8).select("event_id")


_SHIP = "(SELECT l_partkey, l_linenumber, epoch_ms(l_shipdate) // 86400000 AS s, epoch_ms(l_shipdate) // 86400000 + CAST(l_quantity AS BIGINT) AS e FROM lineitem)"


def _ship(spark, d):
    day = F.floor(F.unix_millis(F.col("l_shipdate").cast("timestamp")) / 86_400_000)
    return table(spark, d, "lineitem").select("l_partkey", "l_linenumber", day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"))


@query(f"""WITH p AS (SELECT l_partkey, s, e, max(e) OVER (PARTITION BY l_partkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {_SHIP})
SELECT l_partkey, CAST(sum(greatest(0, e - greatest(s, coalesce(reach, s)))) AS BIGINT) AS days FROM p GROUP BY 1""")
def union_length(spark, d):
    return merging.union_length(_ship(spark, d), ["l_partkey"], "s", "e", "days", counted=True)


@query(f"SELECT DISTINCT a.l_partkey FROM {_SHIP} a JOIN {_SHIP} b ON a.l_partkey = b.l_partkey AND a.l_linenumber <= 2 AND b.l_linenumber >= 5 AND least(a.e, b.e) - greatest(a.s, b.s) > 10")
def interval_conflicts(spark, d):
    rows = _ship(spark, d)
    return merging.conflicting_keys(rows.filter("l_linenumber <= 2"), rows.filter("l_linenumber >= 5"), ["l_partkey"], "s", "e", 10, 32)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE o_orderkey % 7 = 0")
def upsert_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return merging.upsert(o, o.filter("o_orderkey % 7 = 0").withColumn("o_orderstatus", F.lit("X")), "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_orderkey < 100000) WHERE rn <= 3")
def revision_page(spark, d):
    """The newest three revisions of every key before a given one."""
    before = table(spark, d, "orders").filter("o_orderkey < 100000").select("o_custkey", "o_orderkey")
    return bottom_k(before, ["o_custkey"], [F.desc("o_orderkey")], 3)


@query("SELECT event_id, coalesce(nullif(json_extract_string(props, '$.title'), ''), nullif(json_extract_string(props, '$.k'), '0'), 'untitled') AS title FROM events")
def json_fallback(spark, d):
    first = [F.nullif(F.get_json_object("props", path), F.lit(empty)) for path, empty in (("$.title", ""), ("$.k", "0"))]
    return table(spark, d, "events").select("event_id", F.coalesce(*first, F.lit("untitled")).alias("title"))


@query("""SELECT 'order without customer' AS fault, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'line without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def reference_faults(spark, d):
    held = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    live = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    a = table(spark, d, "orders").join(held, "o_custkey", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("order without customer").alias("fault"), "n")
    return a.union(table(spark, d, "lineitem").join(live, "l_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("line without order").alias("fault"), "n"))


_HINTS = """h AS (SELECT conv_id, turn * 20000 // 40000 * 40000 AS t, turn, text, list_concat(CASE WHEN regexp_matches(text, '(?i)\\band\\b') THEN ['and'] ELSE [] END, CASE WHEN regexp_matches(text, '(?i)\\bthe\\b') THEN ['the'] ELSE [] END) AS k FROM conversations),
g AS (SELECT conv_id, t // 120000 AS bucket, count(*) AS hits, CAST(sum(CASE WHEN list_contains(k, 'the') THEN 3 ELSE 0 END + CASE WHEN list_contains(k, 'and') THEN 2 ELSE 0 END) AS BIGINT) AS score, min(t) AS start_ms, max(t) AS end_ms, list((t, text) ORDER BY t, turn, text) AS v, flatten(list(k ORDER BY t, turn, text)) AS w FROM h WHERE len(k) > 0 GROUP BY ALL HAVING count(*) >= 2),
c AS (SELECT conv_id, bucket, hits, score, start_ms, end_ms, v[hits // 2 + 1][1] AS middle_ms, CASE WHEN hits >= 5 OR score >= 12 THEN 'high' WHEN hits >= 3 OR score >= 7 THEN 'medium' ELSE 'low' END AS level, CASE WHEN NOT list_contains(w, 'and') THEN 'the' WHEN NOT list_contains(w, 'the') THEN 'and' WHEN list_position(w, 'and') < list_position(w, 'the') THEN 'and|the' ELSE 'the|and' END AS keywords, array_to_string(list_transform(v[1:3], lambda x: x[2]), '|') AS samples FROM g)"""


def _clusters(spark, d):
    found = [F.when(F.col("text").rlike(rf"(?i)\b{w}\b"), F.lit(w)) for w in ("and", "the")]
    rows = table(spark, d, "conversations").withColumn("k", F.array_compact(F.array(*found))).filter(F.size("k") > 0)
    weight = F.when(F.array_contains("k", "the"), 3).otherwise(0) + F.when(F.array_contains("k", "and"), 2).otherwise(0)
    hits = rows.select("conv_id", (F.floor(F.col("turn") * 20_000 / 40_000) * 40_000).alias("t"), F.struct("turn", "text").alias("place"), "text", weight.alias("w"), "k")
    return merging.cluster_details(hits, ["conv_id"], "t", "place", "text", "w", "k", 120_000, 2, 3)


@query(f"WITH {_HINTS} SELECT * FROM c")
def cluster_details(spark, d):
    return _clusters(spark, d)


@query(f"""WITH {_HINTS}, m AS (SELECT conv_id, turn * 30000 AS at_ms FROM conversations WHERE role = 'user' AND turn % 3 = 0)
SELECT conv_id, bucket, EXISTS (SELECT 1 FROM m WHERE m.conv_id = c.conv_id AND abs(m.at_ms - middle_ms) <= 15000) AS applied FROM c""")
def clusters_applied(spark, d):
    markers = table(spark, d, "conversations").filter("role = 'user' AND turn % 3 = 0").select("conv_id", (F.col("turn") * 30_000).alias("at_ms"))
    return merging.cluster_applied(_clusters(spark, d), markers, ["conv_id"], "middle_ms", "at_ms").select("conv_id", "bucket", "applied")


_FILES = "f AS (SELECT c_custkey AS a, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 END AS season, c_custkey % 40 + 1 AS e0, c_custkey % 40 + 1 + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS e1 FROM customer), i AS (SELECT o_custkey AS a, o_orderkey AS k, o_orderkey % 90000 * 37 AS t FROM orders)"
_SEGMENTS = f"""{_FILES}, x AS (SELECT a, min(t) AS lo, max(t) AS hi FROM i GROUP BY 1),
s AS (SELECT a, name, season, e0 AS e, NULL::INTEGER AS part, 0::BIGINT AS lo, 2000000::BIGINT AS hi, 2000000::BIGINT AS len FROM f WHERE e1 = e0 UNION ALL SELECT a, name, season, e0, 1, coalesce(lo, 0), coalesce(lo + 900000 + 1000 * e0, 0), CASE WHEN lo IS NULL THEN 0 ELSE 900000 + 1000 * e0 END FROM f LEFT JOIN x USING (a) WHERE e1 > e0
UNION ALL SELECT a, name, season, e1, 2, coalesce(lo + 900000 + 1000 * e0, 0), coalesce(lo + 1800000 + 1000 * e0 + 1000 * e1 + 1, 1), CASE WHEN lo IS NULL THEN 0 ELSE 900000 + 1000 * e1 END FROM f LEFT JOIN x USING (a) WHERE e1 > e0),
o AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY season, e ORDER BY a, coalesce(part, 0), name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM s)"""


def _batch(spark, d):
    c = table(spark, d, "customer")
    first = (F.col("c_custkey") % 40 + 1).cast("int")
    files = c.select(F.col("c_custkey").alias("asset_id"), F.col("c_name").alias("file_name"), F.col("c_custkey").alias("source_order"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 3).alias("season"), first.alias("first_episode"), (first + F.when(F.col("c_custkey") % 4 == 0, 1).otherwise(0)).alias("last_episode"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("known_ms"))
    items = table(spark, d, "orders").select(F.col("o_custkey").alias("asset_id"), F.col("o_orderkey").alias("item_id"), F.col("o_orderkey").alias("original_index"), (F.col("o_orderkey") % 90_000 * 37).alias("at_ms"))
    episodes = files.select(F.col("first_episode").alias("e")).union(files.select("last_episode")).distinct()
    known = episodes.select((F.col("e") - 1).cast("int").alias("place"), F.lit(None).cast("long").alias("season"), F.col("e").alias("episode"), (F.lit(900_000) + F.col("e") * 1000).cast("long").alias("length_ms"))
    segments = batch.single_segments(files, items, batch.Window("prefix", 2_000_000)).unionByName(batch.range_segments(files, items, known=known))
    return cut(segments), items


@query(f"WITH {_SEGMENTS} SELECT season, e AS episode, i.a AS asset_id, k AS item_id, t - lo + shift::BIGINT AS final_ms FROM o JOIN i ON i.a = o.a AND t >= lo AND t < hi")
def batch_entries(spark, d):
    """Orders as items of their customers' files, on the clocks of the episodes these are merged into."""
    segments, items = _batch(spark, d)
    return batch.merged_entries(segments, items).select("season", F.col("episode").cast("long").alias("episode"), "asset_id", "item_id", "final_ms")


@query(f"""WITH {_SEGMENTS}, n AS (SELECT season, e, count(*) AS items FROM o JOIN i ON i.a = o.a AND t >= lo AND t < hi GROUP BY ALL)
SELECT o.season, o.e AS episode, CASE WHEN o.season IS NULL THEN o.e || ' - ' || o.e || '.xml' ELSE printf('S%02dE%02d.xml', o.season, o.e) END AS file_name, count(DISTINCT name) AS files, coalesce(any_value(items), 0) AS items FROM o LEFT JOIN n ON n.e = o.e AND n.season IS NOT DISTINCT FROM o.season GROUP BY o.season, o.e""")
def batch_episodes(spark, d):
    segments, items = _batch(spark, d)
    found = batch.episodes(segments, batch.merged_entries(segments, items))
    return found.select("season", F.col("episode").cast("long").alias("episode"), "file_name", F.size("files").cast("long").alias("files"), "items")

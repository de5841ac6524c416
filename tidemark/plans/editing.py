"""Queries that edit clips, selections and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import candidates, edits
from tidemark.plans import bindings as B
from tidemark.plans.collect import collector
from tidemark.session import table

QUERIES, SQL, query = collector()


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_union(spark, d):
    o = table(spark, d, "orders")
    return edits.union_ids(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), "o_custkey")


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_restore(spark, d):
    o = table(spark, d, "orders")
    return edits.without_ids(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), "o_custkey")


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def distinct_first(spark, d):
    return edits.first_by(table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity"), ["l_partkey"], ["l_orderkey", "l_linenumber"])


@query(f"SELECT user_id, string_agg(event_type, ',' ORDER BY t, e) AS kinds FROM (SELECT user_id, event_type, arg_min(t_ms, (t_ms, event_id)) AS t, arg_min(event_id, (t_ms, event_id)) AS e FROM {B.E_SQL} GROUP BY ALL) GROUP BY user_id")
def distinct_strings(spark, d):
    return edits.distinct_in_order(B.events(spark, d), ["user_id"], "event_type", ["t_ms", "event_id"], "kinds").select("user_id", F.array_join("kinds", ",").alias("kinds"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 30)")
def missing_asset_cleanup(spark, d):
    parts = table(spark, d, "part").filter("p_size <= 30").select(F.col("p_partkey").alias("l_partkey"))
    return edits.clips_with_assets(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parts, "l_partkey")


_PLACED = "(SELECT l_partkey, l_returnflag = 'A' AS live FROM lineitem WHERE l_linestatus = 'F' AND l_discount >= 0.09)"


def _placed(spark, d):
    return table(spark, d, "lineitem").filter("l_linestatus = 'F' AND l_discount >= 0.09").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_returnflag") == "A").alias("live"))


@query(f"SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM {_PLACED})")
def unplaced_assets(spark, d):
    return edits.unplaced(table(spark, d, "part").select("p_partkey"), _placed(spark, d), "p_partkey")


@query(f"""SELECT count(*) AS asset_count, count(live) AS placed_count, count(*) FILTER (WHERE NOT live) AS disabled_count, count(*) FILTER (WHERE live IS NULL) AS unplaced_count
FROM part LEFT JOIN (SELECT l_partkey, bool_or(live) AS live FROM {_PLACED} GROUP BY 1) ON l_partkey = p_partkey""")
def placement_summary(spark, d):
    return edits.placement_summary(table(spark, d, "part"), _placed(spark, d), "p_partkey", F.col("live"))


@query("""WITH h AS (SELECT event_id, event_id % 7 * 100 AS ms FROM events WHERE event_id % 3 = 0), c AS (SELECT event_id FROM events WHERE event_id % 4 = 0)
SELECT coalesce(h.event_id, c.event_id) AS event_id, CAST(coalesce(h.ms, 0) + CASE WHEN c.event_id IS NULL THEN 0 ELSE -250 END AS BIGINT) AS ms FROM h FULL JOIN c ON h.event_id = c.event_id""")
def item_adjustments_moved(spark, d):
    e = table(spark, d, "events").select("event_id")
    held = e.filter("event_id % 3 = 0").withColumn("ms", F.col("event_id") % 7 * 100)
    return edits.merge_adjustments(held, e.filter("event_id % 4 = 0"), "event_id", "ms", delta=-250)


@query("""WITH h AS (SELECT event_id, event_id % 7 * 100 AS ms FROM events WHERE event_id % 3 = 0), c AS (SELECT event_id FROM events WHERE event_id % 10 = 0)
SELECT coalesce(h.event_id, c.event_id) AS event_id, CAST(CASE WHEN c.event_id IS NULL THEN h.ms ELSE 40 END AS BIGINT) AS ms FROM h FULL JOIN c ON h.event_id = c.event_id""")
def item_adjustments_set(spark, d):
    e = table(spark, d, "events").select("event_id")
    held = e.filter("event_id % 3 = 0").withColumn("ms", F.col("event_id") % 7 * 100)
    return edits.merge_adjustments(held, e.filter("event_id % 10 = 0"), "event_id", "ms", value=40)


_CLIPS = """(SELECT l_orderkey * 10 + l_linenumber AS clip_id, l_partkey AS asset_id, CAST(floor(l_extendedprice) AS BIGINT) AS line_start, l_suppkey AS in_ms,
l_suppkey + CAST(floor(l_quantity) AS BIGINT) * 1000 AS out_ms, CAST(l_linenumber * 10 - 30 AS BIGINT) AS local_ms, l_returnflag <> 'R' AS enabled FROM lineitem)"""


def _clips(spark, d):
    length = F.floor("l_quantity") * 1000
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("clip_id"), F.col("l_partkey").alias("asset_id"), F.floor("l_extendedprice").alias("line_start"), F.col("l_suppkey").alias("in_ms"),
        (F.col("l_suppkey") + length).alias("out_ms"), (F.col("l_linenumber") * 10 - 30).cast("long").alias("local_ms"), (F.col("l_returnflag") != "R").alias("enabled"),
    )


@query(f"SELECT clip_id, CASE WHEN asset_id % 3 = 0 THEN greatest(0, line_start - 20000) ELSE line_start END AS line_start FROM {_CLIPS}")
def move_clips(spark, d):
    return edits.move(_clips(spark, d), F.col("asset_id") % 3 == 0, "line_start", -20_000).select("clip_id", "line_start")


_SPLIT = f"""(WITH c AS (SELECT *, line_start + local_ms AS vs, line_start + local_ms + greatest(out_ms - in_ms, 0) AS ve, line_start + 17000 AS cutp FROM {_CLIPS}),
f AS (SELECT *, in_ms + cutp - vs AS inner_ms, cutp > vs AND cutp < ve AND in_ms + cutp - vs > in_ms AND in_ms + cutp - vs < out_ms AS fits FROM c)
SELECT clip_id, asset_id, line_start, in_ms, CASE WHEN fits THEN inner_ms ELSE out_ms END AS out_ms, local_ms, enabled, CASE WHEN fits THEN 'A' END AS side FROM f
UNION ALL SELECT clip_id, asset_id, greatest(0, cutp - local_ms), inner_ms, out_ms, local_ms, enabled, 'B' FROM f WHERE fits)"""


@query(f"SELECT clip_id, line_start, in_ms, out_ms, side FROM {_SPLIT}")
def split_clips(spark, d):
    return edits.split_clips(_clips(spark, d).withColumn("at", F.col("line_start") + 17_000), "at").select("clip_id", "line_start", "in_ms", "out_ms", "side")


@query(f"SELECT clip_id AS grp, min(asset_id) AS asset_id, min(line_start) AS line_start, min(in_ms) AS in_ms, max(out_ms) AS out_ms, bool_and(enabled) AS enabled FROM {_SPLIT} GROUP BY clip_id HAVING count(*) = 2 AND count(side) = 2")
def merge_clips(spark, d):
    parts = edits.split_clips(_clips(spark, d).withColumn("at", F.col("line_start") + 17_000), "at").withColumn("grp", F.col("clip_id"))
    return edits.merge_clips(parts, "grp").select("grp", "asset_id", "line_start", "in_ms", "out_ms", "enabled")


_ASSETS = f"(SELECT user_id, event_type, min(t_ms) AS a, max(t_ms) AS b, CASE WHEN event_type = 'view' THEN count(*) * 3600000 WHEN event_type = 'click' THEN 5000 END AS known FROM {B.E_SQL} GROUP BY user_id, event_type)"


def _assets(spark, d):
    known = F.when(F.col("event_type") == "view", F.count(F.lit(1)) * 3_600_000).when(F.col("event_type") == "click", F.lit(5000).cast("long"))
    return B.events(spark, d).groupBy("user_id", "event_type").agg(F.min("t_ms").alias("earliest_ms"), F.max("t_ms").alias("latest_ms"), known.alias("known_ms"))


@query(f"""SELECT user_id, event_type, CAST(coalesce(sum(CASE WHEN known IS NOT NULL THEN greatest(known, b + 1) ELSE greatest(30000, b - a) END) OVER (PARTITION BY user_id ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start,
CAST(CASE WHEN known IS NOT NULL THEN 0 ELSE a END AS BIGINT) AS in_ms, CAST(greatest(coalesce(known, 0), b + 1, a + 1) AS BIGINT) AS out_ms FROM {_ASSETS}""")
def arrange_clips(spark, d):
    return edits.arrange(_assets(spark, d), ["user_id"], ["event_type"])


@query(f"""WITH placed AS (SELECT user_id, event_type, b - a AS e FROM {_ASSETS} WHERE event_type IN ('view', 'signup')), ends AS (SELECT user_id, max(greatest(e, 0)) AS e FROM placed GROUP BY 1),
new AS (SELECT a.user_id, a.event_type, CAST(greatest(coalesce(known, 0), b + 1) AS BIGINT) AS out_ms FROM {_ASSETS} a WHERE event_type NOT IN ('view', 'signup'))
SELECT n.user_id, event_type, CAST(greatest(coalesce(e, 0), 0) + coalesce(sum(out_ms) OVER (PARTITION BY n.user_id ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start, out_ms FROM new n LEFT JOIN ends USING (user_id)""")
def append_unplaced(spark, d):
    assets = _assets(spark, d)
    clips = assets.filter("event_type IN ('view', 'signup')").select("user_id", "event_type", F.lit(0).alias("line_start"), F.lit(0).alias("local_ms"), F.col("earliest_ms").alias("in_ms"), F.col("latest_ms").alias("out_ms"))
    return edits.append_unplaced(assets, clips, ["user_id"], "event_type", ["event_type"])


_NAMES = "(SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'seg ' || lower(c_mktsegment) || '-' || (c_custkey // 10) || '.xml' WHEN c_custkey % 10 = 4 THEN upper(c_name) || '.XML' ELSE 'Seg ' || c_mktsegment || '.xml' END AS name FROM customer)"


@query(f"""WITH n AS (SELECT *, lower(name) AS low, count(*) OVER (PARTITION BY lower(name)) AS n, row_number() OVER (PARTITION BY lower(name) ORDER BY c_custkey) AS place FROM {_NAMES}),
used AS (SELECT low FROM n WHERE n = 1), g AS (SELECT low, max(n) AS n FROM n WHERE n > 1 GROUP BY 1),
x AS (SELECT low, k, row_number() OVER (PARTITION BY low ORDER BY k) AS place FROM (SELECT low, unnest(range(1, n + 1 + (SELECT count(*) FROM used))) AS k FROM g) WHERE regexp_replace(low, '\\.xml$', '') || '-' || k || '.xml' NOT IN (SELECT low FROM used))
SELECT c_custkey, CASE WHEN n > 1 THEN regexp_replace(name, '\\.[xX][mM][lL]$', '') || '-' || k || '.xml' ELSE name END AS unique_name FROM n LEFT JOIN x USING (low, place)""")
def unique_export_names(spark, d):
    c, at = table(spark, d, "customer"), F.col("c_custkey") % 10
    numbered = F.concat(F.lit("seg "), F.lower("c_mktsegment"), F.lit("-"), F.floor(F.col("c_custkey") / 10).cast("string"), F.lit(".xml"))
    name = F.when(at == 3, numbered).when(at == 4, F.concat(F.upper("c_name"), F.lit(".XML"))).otherwise(F.concat(F.lit("Seg "), F.col("c_mktsegment"), F.lit(".xml")))
    return edits.unique_names(c.select("c_custkey", name.alias("name")), "c_custkey", "name").select("c_custkey", "unique_name")


@query("SELECT p_partkey, regexp_replace(CASE WHEN p_size % 9 = 0 THEN 'id' || p_partkey ELSE replace(p_name, ' ', ' / ') || CASE WHEN p_size % 2 = 0 THEN ': a?b' ELSE '' END END, '[\\\\/:*?\"<>|]+', '_', 'g') || '.xml' AS name FROM part")
def export_names(spark, d):
    raw = F.when(F.col("p_size") % 9 == 0, F.lit(" .mp4")).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit(" / ")), F.when(F.col("p_size") % 2 == 0, ": a?b").otherwise(""), F.when(F.col("p_size") % 3 == 0, ".MKV").otherwise(".mp4")))
    return table(spark, d, "part").select("p_partkey", edits.export_name(raw, F.concat(F.lit("id"), F.col("p_partkey").cast("string"))).alias("name"))


_SUITES = "(SELECT o_custkey AS suite, round(avg(o_totalprice), 2) AS boundary, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)::DOUBLE, 6) AS f1 FROM orders WHERE {} GROUP BY 1)"


@query(f"""SELECT suite, CASE WHEN a.f1 IS NULL THEN 'added' WHEN b.f1 IS NULL THEN 'missing' WHEN b.boundary - a.boundary > 250 OR b.f1 - a.f1 < -0.02 THEN 'regressed' ELSE 'held' END AS change
FROM {_SUITES.format("o_orderkey % 2 = 0")} a FULL JOIN {_SUITES.format("o_orderkey % 2 = 1")} b USING (suite)""")
def suite_regression(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "suite")

    def run(part):
        return o.filter(F.col("o_orderkey") % 2 == part).groupBy("suite").agg(F.round(F.avg("o_totalprice"), 2).alias("boundary"), F.round(F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1)), 6).alias("f1"))

    return edits.suite_changes(run(0), run(1), "suite", {"boundary": 250, "f1": -0.02})


@query("""WITH c AS (SELECT o_orderkey AS id, o_custkey % 20 AS s, o_orderkey % 5 AS t, o_orderkey % 3000 * 100 AS a, o_orderkey % 3000 * 100 + 500 + o_custkey % 3 * 400 AS b, o_custkey % 40 AS asset, o_orderkey % 7 = 0 AS no FROM orders),
r AS (SELECT *, CASE WHEN no THEN 'rejected' WHEN t = 4 THEN 'media' WHEN asset = 3 THEN 'otherSource' WHEN asset = 5 THEN 'notBound' WHEN a < 20000 + asset * 1000 AND b > 0 THEN 'overlap' END AS reason FROM c),
l AS (SELECT DISTINCT x.id FROM r x JOIN r y ON x.asset = y.asset AND x.t = y.t AND y.id < x.id AND x.a < y.b AND y.a < x.b WHERE x.reason IS NULL AND y.reason IS NULL)
SELECT r.id::VARCHAR AS candidate_id, coalesce(reason, CASE WHEN l.id IS NOT NULL THEN 'overlap' END) AS reason FROM r LEFT JOIN l ON l.id = r.id""")
def candidate_acceptances(spark, d):
    """Orders as matches, each asked to be accepted with one asset; ids that order as numbers do."""
    o = table(spark, d, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    id_ = F.lpad(key.cast("string"), 12, "0")
    start = key % 3000 * 100
    rows = o.select(id_.alias("candidate_id"), name("s", cust % 20).alias("source_media"), name("t", key % 5).alias("target_media"), start.alias("source_start"), (start + 500 + cust % 3 * 400).alias("source_end"), F.lit(0).cast("long").alias("target_start"), (start + 500).alias("target_end"), F.when(key % 7 == 0, "rejected").otherwise("pending").alias("state"), F.lit(None).cast("string").alias("map_id"), F.lit(False).alias("blocked"))
    requests = o.select(id_.alias("candidate_id"), name("a", cust % 40).alias("asset_id"))
    k = o.select((cust % 40).alias("k")).distinct()
    assets = k.select(name("a", F.col("k")).alias("asset_id"))
    bindings = k.filter("k <> 5").select(name("a", F.col("k")).alias("asset_id"), name("s", F.when(F.col("k") == 3, 19).otherwise(F.col("k") % 20)).alias("source_media"))
    media = k.select(name("s", F.col("k") % 20).alias("media_id"), F.lit(candidates.SOURCE_ROLE).alias("role")).union(k.select(name("t", F.col("k") % 5), F.when(F.col("k") % 5 == 4, "other").otherwise(candidates.TARGET_ROLE))).distinct()
    held = k.select(name("skip", F.col("k")).alias("segment_id"), F.lit("ignored").alias("kind"), name("a", F.col("k")).alias("asset_id"), name("s", F.col("k") % 20).alias("source_media"), F.lit(None).cast("string").alias("target_media"), F.lit(None).cast("string").alias("map_id"), F.lit(0).cast("long").alias("source_start"), (F.lit(20_000) + F.col("k") * 1000).cast("long").alias("source_end"))
    maps = spark.createDataFrame([], "map_id string, candidate_id string, state string, revision int, level string")
    out = candidates.acceptances(requests, rows, held, maps, bindings, assets, media, width=2_000)
    return out.select(F.col("candidate_id").cast("long").cast("string").alias("candidate_id"), "reason")

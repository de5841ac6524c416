"""Queries that look up times, neighbours, names and spans."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.functions import rules
from tidemark.operators import intervals, lookup, matching, timemap
from tidemark.plans import bindings as B
from tidemark.plans.collect import collector
from tidemark.session import table

QUERIES, SQL, query = collector()

PROBES = [0, B.DAY, 5 * B.DAY + 1, 20 * B.DAY, 400 * B.DAY]


@query(f"SELECT probe::BIGINT AS probe, count(*) FILTER (WHERE t_ms < probe) AS lower, count(*) FILTER (WHERE t_ms <= probe) AS upper FROM {B.E_SQL}, (VALUES {', '.join(f'({p})' for p in PROBES)}) v(probe) GROUP BY probe")
def range_bounds(spark, d):
    return lookup.bounds(B.events(spark, d), "t_ms", PROBES)


@query(f"SELECT event_id, t_ms FROM {B.E_SQL} WHERE t_ms BETWEEN {3 * B.DAY} AND {4 * B.DAY}")
def range_slice(spark, d):
    return lookup.in_range(B.events(spark, d), "t_ms", 3 * B.DAY, 4 * B.DAY).select("event_id", "t_ms")


@query("SELECT event_id, CASE WHEN value * 5 < 18 THEN 30000 WHEN value * 5 < 45 THEN 10000 WHEN value * 5 < 130 THEN 1000 WHEN value * 5 < 420 THEN 500 ELSE 100 END AS width FROM events")
def bucket_sizes(spark, d):
    return table(spark, d, "events").select("event_id", lookup.bucket_width(F.col("value") * 5).alias("width"))


_STEP = f"coalesce(list_filter([{', '.join(map(str, lookup.STEPS_MS))}], lambda s: s >= greatest(1, b - a) / 10.0::DOUBLE)[1], CAST(ceil(greatest(1, b - a) / 10.0::DOUBLE / 3600000) AS BIGINT) * 3600000)::BIGINT"


@query(f"""WITH r AS (SELECT user_id, min(t_ms) AS a, max(t_ms) AS b FROM {B.E_SQL} GROUP BY 1 UNION ALL SELECT -event_id, t_ms, t_ms + event_id * 100 FROM {B.E_SQL} WHERE event_type = 'purchase'), s AS (SELECT *, {_STEP} AS step_ms FROM r),
t AS (SELECT user_id, step_ms, unnest(generate_series(CAST(ceil(a / step_ms::DOUBLE) AS BIGINT) * step_ms, b, step_ms)) AS tick_ms FROM s)
SELECT user_id, step_ms, tick_ms, CASE WHEN tick_ms // 3600000 > 0 THEN (tick_ms // 3600000) || ':' ELSE '' END || printf('%02d:%02d', tick_ms // 60000 % 60, tick_ms // 1000 % 60) || CASE WHEN step_ms < 1000 THEN printf('.%03d', tick_ms % 1000) ELSE '' END AS label FROM t""")
def time_ticks(spark, d):
    e = B.events(spark, d)
    ranges = e.groupBy("user_id").agg(F.min("t_ms").alias("a"), F.max("t_ms").alias("b"))
    short = e.filter("event_type = 'purchase'").select((-F.col("event_id")).alias("user_id"), F.col("t_ms").alias("a"), (F.col("t_ms") + F.col("event_id") * 100).alias("b"))
    ticks = lookup.axis_ticks(ranges.union(short), "a", "b", 950)
    return ticks.select("user_id", "step_ms", "tick_ms", lookup.clock(F.col("tick_ms"), F.col("step_ms") < 1000).alias("label"))


_VIEWS = f"(SELECT user_id, t_ms, max(value) AS value FROM {B.E_SQL} WHERE event_type = 'view' GROUP BY ALL)"


@query(f"""WITH c AS (SELECT e.event_id, e.t_ms, v.t_ms AS vt, v.value, min(v.t_ms) OVER (PARTITION BY e.event_id) AS a, max(v.t_ms) OVER (PARTITION BY e.event_id) AS b FROM {B.E_SQL} e JOIN {_VIEWS} v ON v.user_id = e.user_id WHERE e.event_type = 'click'),
n AS (SELECT event_id, arg_min(value, (abs(vt - t_ms), -vt)) AS near, arg_min(vt, (abs(vt - t_ms), -vt)) AS near_at FROM c WHERE t_ms BETWEEN a AND b GROUP BY 1)
SELECT e.event_id, near, near_at FROM {B.E_SQL} e LEFT JOIN n USING (event_id) WHERE e.event_type = 'click'""")
def asof_nearest(spark, d):
    e = B.events(spark, d)
    views = e.filter("event_type = 'view'").groupBy("user_id", "t_ms").agg(F.max("value").alias("value"))
    return lookup.nearest(e.filter("event_type = 'click'").select("event_id", "user_id", "t_ms"), views, ["user_id"], "t_ms", "value", "near").select("event_id", "near", "near_at")


_ANCHORS = f"(SELECT user_id, t_ms, CAST(floor(value * 10) AS BIGINT) AS o FROM {B.E_SQL} WHERE event_type = 'purchase')"


@query(f"""WITH x AS (SELECT e.event_id, e.t_ms, (SELECT max((a.t_ms, a.o)) FROM {_ANCHORS} a WHERE a.user_id = e.user_id AND a.t_ms <= e.t_ms) AS b, (SELECT min((a.t_ms, a.o)) FROM {_ANCHORS} a WHERE a.user_id = e.user_id AND a.t_ms >= e.t_ms) AS f FROM {B.E_SQL} e WHERE e.event_type = 'view')
SELECT event_id, CASE WHEN b IS NOT NULL AND f IS NOT NULL THEN CASE WHEN abs(b[2] - f[2]) <= 300 THEN CAST(trunc((b[2] + f[2]) / 2) AS BIGINT) END WHEN b IS NOT NULL AND t_ms - b[1] <= 90000000 THEN b[2] WHEN f IS NOT NULL AND f[1] - t_ms <= 90000000 THEN f[2] END AS offset_ms FROM x""")
def anchor_brace(spark, d):
    e = B.events(spark, d)
    anchors = e.filter("event_type = 'purchase'").select("user_id", "t_ms", F.floor(F.col("value") * 10).alias("o"))
    return lookup.braced_offset(e.filter("event_type = 'view'").select("event_id", "user_id", "t_ms"), anchors, ["user_id"], "t_ms", "o", 300, 90_000_000, "offset_ms").select("event_id", "offset_ms")


@query("""WITH p AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_suppkey) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS i FROM lineitem),
k AS (SELECT DISTINCT l_suppkey, CAST(floor(k * ((n - 1) / 31.0::DOUBLE) + 0.5) AS BIGINT) AS i, true AS wanted FROM p, range(0, 32) r(k) WHERE n > 32)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM p LEFT JOIN k USING (l_suppkey, i) WHERE n <= 32 OR wanted""")
def even_sample(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return lookup.even_sample(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], 32)


@query("""WITH f AS (SELECT p_partkey, p_size * 7 + 3 AS n FROM part), s AS (SELECT p_partkey, n, range(0, n - 40 + 1, 12) AS v FROM f WHERE n >= 40), t AS (SELECT p_partkey, CASE WHEN v[len(v)] < n - 40 THEN list_append(v, n - 40) ELSE v END AS v FROM s)
SELECT f.p_partkey, coalesce(array_to_string(CASE WHEN len(v) > 8 THEN list_transform(range(0, 8), lambda i: v[CAST(i * (len(v) - 1) // 7 AS BIGINT) + 1]) ELSE v END, ','), '') AS starts FROM f LEFT JOIN t USING (p_partkey)""")
def block_starts(spark, d):
    frames = (F.col("p_size") * 7 + 3).cast("long")
    return table(spark, d, "part").select("p_partkey", F.array_join(lookup.block_starts(frames, 40, 12, 8).cast("array<string>"), ",").alias("starts"))


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


@query(f"""WITH p AS (SELECT vec_id, embedding AS v, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings)
SELECT vec_id, CAST(floor(least(greatest(1 - {_DOT.format(a="v", b="w")} / (sqrt({_DOT.format(a="v", b="v")}) * sqrt({_DOT.format(a="w", b="w")})), 0), 2) * 1000 + 0.5) AS BIGINT) AS cost,
round(sqrt(list_sum(list_transform(list_zip(v, w), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) / 64), 6) AS rms FROM p WHERE w IS NOT NULL""")
def neighbour_costs(spark, d):
    before = F.lag("embedding").over(W.partitionBy("label").orderBy("vec_id"))
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"), before.alias("w")).filter("w IS NOT NULL")
    return rows.select("vec_id", matching.cosine_cost(F.col("v"), F.col("w")).alias("cost"), F.round(matching.rms_distance(F.col("v"), F.col("w")), 6).alias("rms"))


@query("""WITH s AS (SELECT l_suppkey, epoch_ms(l_shipdate) // 86400000 AS day, sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = 'N') AS a, sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag <> 'N') AS b FROM lineitem GROUP BY ALL)
SELECT l_suppkey, count(*) AS n, round(greatest(0, corr(coalesce(a, 0), coalesce(b, 0))), 6) AS fit FROM s GROUP BY 1 HAVING count(*) >= 8""")
def rms_envelope_corr(spark, d):
    day = F.floor(F.unix_millis(F.col("l_shipdate").cast("timestamp")) / 86_400_000)
    q, n = F.col("l_quantity").cast("long"), F.col("l_returnflag") == "N"
    days = table(spark, d, "lineitem").groupBy("l_suppkey", day.alias("day")).agg(F.sum(F.when(n, q)).alias("a"), F.sum(F.when(~n, q)).alias("b"))
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    fits = days.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("fit")).filter("n >= 8")
    return fits.select("l_suppkey", "n", F.round(F.greatest(F.lit(0.0), "fit"), 6).alias("fit"))


_H = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296)"


@query(f"SELECT c_custkey, {_H} AS h, {list(N.COLORS)}[abs(CASE WHEN {_H} >= 2147483648 THEN {_H} - 4294967296 ELSE {_H} END) % 7 + 1] AS color FROM customer")
def stable_hashes(spark, d):
    name = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", F.conv(N.stable_hash(name), 36, 10).cast("long").alias("h"), N.color_of(name).alias("color"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, ((l_linenumber::BIGINT << 16) | ((l_suppkey % 256) << 8) | CAST(floor(l_quantity * 20 / 50) AS BIGINT)) AS k FROM lineitem")
def landmark_keys(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", N.landmark_key(F.col("l_linenumber"), F.col("l_suppkey") % 256, F.col("l_quantity") * 20).alias("k"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || '第 ' || p_size || ' 季.MKV'), '\\.[a-z0-9]+$', ''), '第\\s*([0-9]+)\\s*季', 's\\1')) AS key, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_size::BIGINT ELSE -p_size::BIGINT END AS whole FROM part")
def name_keys(spark, d):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(size, F.lit("x"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit(" "), size, F.lit(".7 "))).otherwise(F.concat(F.lit("-"), size, F.lit("e0")))
    return table(spark, d, "part").select("p_partkey", N.score_text(F.concat("p_name", F.lit("第 "), size, F.lit(" 季.MKV"))).alias("key"), rules.whole_number(text).alias("whole"))


_S, _E, _P = "1 + o_orderkey % 12", "1 + o_custkey % 60", "o_orderkey % 8"


@query(f"""SELECT o_orderkey, CASE WHEN {_P} IN (0, 1, 2, 7) THEN CAST({_S} AS INTEGER) END AS season, CAST({_E} AS INTEGER) AS first, CAST(CASE WHEN {_P} IN (1, 4) THEN {_E} + 3 ELSE {_E} END AS INTEGER) AS last, CAST(CASE WHEN {_P} = 3 THEN {_E} WHEN {_P} = 6 THEN 2 WHEN {_P} = 7 THEN 3 END AS INTEGER) AS part,
CASE {_P} WHEN 0 THEN 'seasonEpisode' WHEN 1 THEN 'seasonEpisodeRange' WHEN 2 THEN 'seasonEpisode' WHEN 4 THEN 'episodeRange' WHEN 5 THEN 'episode' ELSE 'episodePart' END AS pattern,
CASE WHEN {_P} IN (0, 1, 2, 3, 6, 7) THEN 'strong' ELSE 'moderate' END AS strength FROM orders""")
def episode_identity(spark, d):
    o, p = table(spark, d, "orders"), F.col("o_orderkey") % 8
    s, e = (1 + F.col("o_orderkey") % 12).cast("string"), (1 + F.col("o_custkey") % 60).cast("string")
    later = (4 + F.col("o_custkey") % 60).cast("string")
    name = (
        F.when(p == 0, F.concat(F.lit("Show S"), s, F.lit("E"), e, F.lit(" 全80集")))
        .when(p == 1, F.concat(F.lit("Ｓ"), s, F.lit("Ｅ"), e, F.lit("～"), later))
        .when(p == 2, F.concat(F.lit("剧 第"), s, F.lit("季第"), e, F.lit("集")))
        .when(p == 3, F.concat(F.lit("title EP"), e))
        .when(p == 4, F.concat(F.lit("第"), e, F.lit("至"), later, F.lit("话")))
        .when(p == 5, F.concat(F.lit("第 "), e, F.lit(" 話")))
        .when(p == 6, F.concat(F.lit("E"), e, F.lit(" part 2")))
        .otherwise(F.concat(F.lit("s"), s, F.lit(" e"), e, F.lit(" pt3")))
    )
    return o.select("o_orderkey", N.episode_identity(name).alias("i")).select("o_orderkey", "i.*")


@query(f"""WITH c AS (SELECT e.event_id, s.*, e.t_ms FROM {B.E_SQL} e JOIN {B.SPANS_SQL} s ON s.map_id = e.event_type AND s.s1 > s.s0 AND e.t_ms >= s.s0 AND e.t_ms < s.s1)
SELECT event_id, CASE WHEN t1 <= t0 THEN 'unavailable' WHEN kind = 'ambiguous' THEN 'independent' WHEN kind = 'matched' THEN 'mapped' ELSE 'unavailable' END AS status,
CASE WHEN t1 <= t0 THEN NULL WHEN kind = 'ambiguous' THEN t0 WHEN kind = 'matched' THEN least(t1 - 1, t0 + CAST((2 * CAST(t_ms - s0 AS HUGEINT) * (t1 - t0) + (s1 - s0)) // (2 * (s1 - s0)) AS BIGINT)) END AS position FROM c""")
def timemap_counterpart(spark, d):
    spans = B.spans(spark).filter("source_end > source_start").withColumnRenamed("map_id", "event_type")
    met = intervals.point_in_interval_join(B.events(spark, d), spans, ["event_type"], "t_ms", "source_start", "source_end", B.DAY)
    status, position = timemap.span_counterpart(F.col("t_ms"), "source")
    return met.select("event_id", status.alias("status"), position.alias("position"))


_RULES = "(SELECT o_custkey AS map_id, o_orderkey % 90000 AS at_ms, CASE WHEN o_orderkey % 11 = 0 THEN -500 WHEN o_orderkey % 7 = 0 THEN 0 ELSE CAST(floor(o_totalprice / 100) AS BIGINT) END AS gap FROM orders)"


@query(f"""WITH p AS (SELECT map_id, at_ms, CAST(sum(greatest(gap, 0)) AS BIGINT) AS gap, bool_or(gap < 0) AS stop FROM {_RULES} GROUP BY ALL),
q AS (SELECT * FROM (SELECT *, max(stop::INT) OVER (PARTITION BY map_id ORDER BY at_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM p) WHERE coalesce(stopped, 0) = 0),
m AS (SELECT map_id, at_ms, gap, stop, coalesce(lag(at_ms) OVER w, 0) AS from_ms, 1000 + coalesce(sum(gap) OVER (PARTITION BY map_id ORDER BY at_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift, lead(at_ms) OVER w IS NULL AS last FROM q WINDOW w AS (PARTITION BY map_id ORDER BY at_ms)),
s AS (SELECT map_id, at_ms, 0 AS part, 'matched' AS kind, from_ms AS source_start, at_ms AS source_end, from_ms + shift AS target_start, at_ms + shift AS target_end FROM m WHERE at_ms > from_ms
UNION ALL SELECT map_id, at_ms, 1, 'targetOnly', at_ms, at_ms, at_ms + shift, at_ms + shift + gap FROM m WHERE NOT stop AND gap > 0
UNION ALL SELECT map_id, at_ms, 2, 'ambiguous', at_ms, 90000, at_ms + shift, at_ms + shift FROM m WHERE stop AND at_ms < 90000
UNION ALL SELECT map_id, at_ms, 3, 'matched', at_ms, 90000, at_ms + shift + gap, 90000 + shift + gap FROM m WHERE last AND NOT stop AND at_ms < 90000)
SELECT map_id, CAST(row_number() OVER (PARTITION BY map_id ORDER BY at_ms, part) - 1 AS INTEGER) AS span_index, kind, source_start::BIGINT AS source_start, source_end::BIGINT AS source_end, target_start::BIGINT AS target_start, target_end::BIGINT AS target_end FROM s""")
def timemap_migrate(spark, d):
    o = table(spark, d, "orders")
    gap = F.when(F.col("o_orderkey") % 11 == 0, F.lit(-500)).when(F.col("o_orderkey") % 7 == 0, F.lit(0)).otherwise(F.floor(F.col("o_totalprice") / 100)).cast("long")
    rules = o.select(F.col("o_custkey").alias("map_id"), (F.col("o_orderkey") % 90_000).alias("at"), gap.alias("gap"))
    maps = rules.select("map_id").distinct().select("map_id", F.lit(0).cast("long").alias("source_start"), F.lit(90_000).cast("long").alias("source_end"), F.lit(1000).cast("long").alias("target_start"))
    return timemap.legacy_spans(maps, rules)


@query(f"""WITH r AS (SELECT map_id, at_ms, gap, rule FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY o_orderkey) - 1 AS rule FROM (SELECT o_custkey AS map_id, o_orderkey, o_orderkey % 90000 - CASE WHEN o_orderkey % 401 = 0 THEN 90000 ELSE 0 END AS at_ms, CASE WHEN o_orderkey % 11 = 0 THEN -500 WHEN o_orderkey % 7 = 0 THEN 0 ELSE 5 END AS gap FROM orders))),
b AS (SELECT map_id, min(at_ms) < 0 AS bad, min(at_ms) FILTER (WHERE gap < 0) AS stop FROM r GROUP BY 1), n AS (SELECT r.map_id, min(rule) AS rule FROM r JOIN b USING (map_id) WHERE at_ms = stop AND gap < 0 GROUP BY 1),
i AS (SELECT map_id, 'invalidInput' AS code, NULL::INTEGER AS rule, 0::BIGINT AS at_ms FROM b WHERE map_id % 31 = 0 UNION ALL SELECT map_id, 'invalidRule', rule, at_ms FROM r WHERE at_ms < 0 AND map_id % 31 <> 0
UNION ALL SELECT map_id, 'zeroGapIgnored', rule, at_ms FROM r JOIN b USING (map_id) WHERE gap = 0 AND NOT bad AND map_id % 31 <> 0 AND (stop IS NULL OR at_ms < stop) UNION ALL SELECT map_id, 'negativeGap', n.rule, stop FROM n JOIN b USING (map_id) WHERE NOT bad AND map_id % 31 <> 0)
SELECT b.map_id, CASE WHEN b.map_id % 31 = 0 OR bad OR stop IS NOT NULL THEN 'blocked' ELSE 'migrated' END AS status, coalesce(string_agg(code || coalesce(':' || i.rule, ''), ' ' ORDER BY at_ms, i.rule), '') AS issues FROM b LEFT JOIN i USING (map_id) GROUP BY b.map_id, bad, stop""")
def timemap_migrate_issues(spark, d):
    o = table(spark, d, "orders")
    gap = F.when(F.col("o_orderkey") % 11 == 0, F.lit(-500)).when(F.col("o_orderkey") % 7 == 0, F.lit(0)).otherwise(5).cast("long")
    at = F.col("o_orderkey") % 90_000 - F.when(F.col("o_orderkey") % 401 == 0, F.lit(90_000)).otherwise(0)
    rule = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rules = o.select(F.col("o_custkey").alias("map_id"), at.alias("at"), gap.alias("gap"), rule.alias("rule"))
    end = F.when(F.col("map_id") % 31 == 0, F.lit(0)).otherwise(90_000).cast("long")
    maps = rules.select("map_id").distinct().select("map_id", F.lit(0).cast("long").alias("source_start"), end.alias("source_end"), F.lit(1000).cast("long").alias("target_start"))
    found = timemap.legacy_migration(maps, rules)
    return found.select("map_id", "status", F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["code"], i["rule"].cast("string"))), " ").alias("issues"))


def _grid(spark, d):
    """Four spans per customer that follow each other, of two kinds by turns or alike."""
    k, c = F.col("k"), F.col("c_custkey")
    kind = F.when((c + F.floor(k / 2)) % 3 == 0, "ambiguous").otherwise("matched")
    rows = table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    return rows.select(c.alias("map_id"), k.alias("span_index"), kind.alias("kind"), (k * 1000).cast("long").alias("source_start"), (k * 1000 + 1000).cast("long").alias("source_end"), (k * 900 + c % 5).alias("target_start"), (k * 900 + 900 + c % 5).alias("target_end"))


_GRID = "(SELECT c_custkey AS map_id, k::INTEGER AS span_index, CASE WHEN (c_custkey + k // 2) % 3 = 0 THEN 'ambiguous' ELSE 'matched' END AS kind, k * 1000 AS s0, k * 1000 + 1000 AS s1, k * 900 + c_custkey % 5 AS t0, k * 900 + 900 + c_custkey % 5 AS t1 FROM customer, range(0, 4) r(k))"


@query(f"""WITH j AS (SELECT *, span_index = 1 AND lag(kind) OVER w = kind OR span_index = 3 AND map_id % 2 = 0 AND lag(kind) OVER w = kind AS joined FROM {_GRID} WINDOW w AS (PARTITION BY map_id ORDER BY span_index)),
r AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY map_id ORDER BY span_index) AS run FROM j)
SELECT map_id, CAST(run - 1 AS INTEGER) AS span_index, min(kind) AS kind, min(s0) AS source_start, max(s1) AS source_end, min(t0) AS target_start, max(t1) AS target_end FROM r GROUP BY map_id, run""")
def timemap_merge(spark, d):
    grid = _grid(spark, d)
    return timemap.merge_spans(grid, grid.filter((F.col("span_index") == 0) | ((F.col("span_index") == 2) & (F.col("map_id") % 2 == 0))))


@query(f"""SELECT map_id, span_index, CASE WHEN span_index = 1 AND map_id % 3 = 0 THEN 'sourceOnly' ELSE kind END AS kind,
CASE WHEN map_id % 3 = 0 AND span_index = 1 THEN 950 WHEN map_id % 3 = 0 AND span_index = 2 THEN 2100 ELSE s0 END::BIGINT AS source_start, CASE WHEN map_id % 3 = 0 AND span_index = 0 THEN 950 WHEN map_id % 3 = 0 AND span_index = 1 THEN 2100 ELSE s1 END::BIGINT AS source_end,
CASE WHEN map_id % 3 = 0 AND span_index IN (1, 2) THEN 1500 ELSE t0 END AS target_start, CASE WHEN map_id % 3 = 0 AND span_index IN (0, 1) THEN 1500 ELSE t1 END AS target_end FROM {_GRID}""")
def timemap_edit(spark, d):
    grid = _grid(spark, d)
    patch = grid.filter("span_index = 1 AND map_id % 3 = 0").select("map_id", "span_index", F.lit("sourceOnly").alias("kind"), *[F.lit(v).cast("long").alias(c) for c, v in (("source_start", 950), ("source_end", 2100), ("target_start", 1500), ("target_end", 1500))])
    return timemap.edit_spans(grid, patch)


@query(f"""WITH g AS (SELECT *, span_index = 2 AND map_id % 2 = 0 AS hit, s0 + (map_id % 3) * 200 AS a, t0 + 100 AS c FROM {_GRID}), h AS (SELECT *, t0 + 100 AS x FROM g),
p AS (SELECT map_id, span_index, 0 AS part, kind, s0, s1, t0, t1 FROM h WHERE NOT hit UNION ALL SELECT map_id, span_index, 0, 'matched', s0, a, t0, c FROM h WHERE hit
UNION ALL SELECT map_id, span_index, 1, 'targetOnly', a, a, c, c + 50 FROM h WHERE hit UNION ALL SELECT map_id, span_index, 2, 'matched', a, s1, c + 50, t1 FROM h WHERE hit)
SELECT map_id, CAST(row_number() OVER (PARTITION BY map_id ORDER BY span_index, part) - 1 AS INTEGER) AS span_index, kind, s0 AS source_start, s1 AS source_end, t0 AS target_start, t1 AS target_end FROM p""")
def timemap_gap_resolve(spark, d):
    grid = _grid(spark, d)
    a, c = F.col("source_start") + F.col("map_id") % 3 * 200, F.col("target_start") + 100
    gaps = grid.filter("span_index = 2 AND map_id % 2 = 0").select("map_id", "span_index", a.alias("a"), a.alias("b"), c.alias("c"), (c + 50).alias("d"))
    return timemap.resolve_gap(grid, gaps)

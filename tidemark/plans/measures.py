"""Queries over ranks, residuals, metrics, quality and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import measures
from tidemark.plans import bindings as B
from tidemark.plans.collect import collector
from tidemark.session import table

QUERIES, SQL, query = collector()


@query("SELECT l_suppkey, len(v) AS n, v[CAST(ceil((len(v) - 1) * 0.5) AS BIGINT) + 1] AS p50, v[CAST(ceil((len(v) - 1) * 0.95) AS BIGINT) + 1] AS p95, v[CAST(ceil((len(v) - 1) * 0.99) AS BIGINT) + 1] AS p99, v[len(v)] AS most FROM (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1)")
def rust_percentile(spark, d):
    n = F.col("n")
    places = {"p50": measures.upper_index(0.5, n), "p95": measures.upper_index(0.95, n), "p99": measures.upper_index(0.99, n), "most": n - 1}
    return measures.values_at_ranks(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", places)


@query(f"""SELECT user_id, greatest(coalesce(max(g), 0), min(t_ms) - 1000000, 2600000000 - max(t_ms), 0)::BIGINT AS hole_ms FROM (SELECT user_id, t_ms, t_ms - lag(t_ms) OVER (PARTITION BY user_id ORDER BY t_ms) AS g FROM {B.E_SQL}) GROUP BY user_id""")
def max_unvalidated_gap(spark, d):
    return measures.largest_hole(B.events(spark, d), ["user_id"], "t_ms", F.lit(1_000_000).cast("long"), F.lit(2_600_000_000).cast("long"), "hole_ms")


_RESIDUAL = f"(SELECT user_id, t_ms, CAST(floor(value * 100) AS BIGINT) AS residual FROM {B.E_SQL})"


@query(f"""WITH g AS (SELECT *, t_ms - lag(t_ms) OVER w AS x, lead(t_ms) OVER w - t_ms AS y, lag(residual) OVER w AS p, lead(residual) OVER w AS q FROM {_RESIDUAL} WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, residual)),
r AS (SELECT user_id, t_ms, residual, greatest(residual, CASE WHEN x IS NULL OR y < x THEN q WHEN y IS NULL OR x < y THEN p ELSE greatest(p, q) END, residual) AS alone FROM g),
v AS (SELECT user_id, list((t_ms, residual, alone)) OVER (PARTITION BY user_id ORDER BY t_ms RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS v FROM r UNION ALL SELECT user_id, list((t_ms, residual, alone)) OVER (PARTITION BY user_id ORDER BY t_ms RANGE BETWEEN 1 FOLLOWING AND 600000000 FOLLOWING) FROM r)
SELECT user_id, max(CASE WHEN len(v) >= 5 THEN list_sort(list_transform(v, lambda z: z[2]))[CAST(ceil((len(v) - 1) * 95 / 100) AS BIGINT) + 1] ELSE list_sort(v)[1][3] END) AS worst_p95 FROM v WHERE len(v) > 0 GROUP BY 1""")
def worst_window_p95(spark, d):
    rows = B.events(spark, d).select("user_id", "t_ms", F.floor(F.col("value") * 100).alias("residual"))
    return measures.worst_window_p95(rows, ["user_id"], "t_ms", "residual", 600_000_000, 5, "worst_p95")


_RATES = """CASE WHEN tp + fp = 0 THEN CASE WHEN fn = 0 THEN 1 ELSE 0 END ELSE tp / (tp + fp)::DOUBLE END AS p, CASE WHEN tp + fn = 0 THEN CASE WHEN fp = 0 THEN 1 ELSE 0 END ELSE tp / (tp + fn)::DOUBLE END AS r"""
_SHOWN = "round(p::DOUBLE, 6) AS precision_, round(r::DOUBLE, 6) AS recall_, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END::DOUBLE, 6) AS f1"
_CASES = """(SELECT s_nationkey AS case_id, CAST(count(*) FILTER (WHERE l_quantity > 40 AND l_returnflag = 'R') AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE l_quantity > 40 AND l_returnflag <> 'R') AS BIGINT) AS fp,
CAST(count(*) FILTER (WHERE l_quantity <= 40 AND l_returnflag = 'R') AS BIGINT) AS fn, l_suppkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_nationkey, l_suppkey)"""


@query(f"""WITH c AS (SELECT *, list_distinct(['nation' || case_id % 3, CASE WHEN case_id % 2 = 0 THEN 'even' ELSE 'nation' || case_id % 3 END, 'overall']) AS s FROM {_CASES}),
x AS (SELECT unnest(s) AS scenario, tp, fp, fn FROM c), g AS (SELECT scenario, count(*) AS cases, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM x GROUP BY 1), r AS (SELECT *, {_RATES} FROM g)
SELECT scenario, cases, tp, fp, fn, {_SHOWN} FROM r""")
def scenario_rollup(spark, d):
    hit, real = F.col("l_quantity") > 40, F.col("l_returnflag") == "R"
    of = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    cases = table(spark, d, "lineitem").join(of, "l_suppkey").groupBy("s_nationkey", "l_suppkey").agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"))
    name = F.concat(F.lit("nation"), (F.col("s_nationkey") % 3).cast("string"))
    return measures.rollup(cases.withColumn("scenarios", F.array_distinct(F.array(name, F.when(F.col("s_nationkey") % 2 == 0, "even").otherwise(name)))), "scenarios")


#: Median, mean, scale and weight of size, retail price and a share that is missing in places.
MODEL = ([25.0, 1000.0, 0.5], [25.0, 1200.0, 0.4], [14.0, 300.0, 0.25], [0.8, -1.1, 0.6], -0.2)
_RISK = """(SELECT p_partkey, p_size, 1 - CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END AS risk FROM (SELECT p_partkey, p_size,
-0.2 + (p_size - 25.0::DOUBLE) / 14.0::DOUBLE * 0.8::DOUBLE + (p_retailprice - 1200.0::DOUBLE) / 300.0::DOUBLE * -1.1::DOUBLE + (coalesce(CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size / 50.0::DOUBLE END, 0.5) - 0.4::DOUBLE) / 0.25::DOUBLE * 0.6::DOUBLE AS z FROM part))"""


def _risk(spark, d):
    share = F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") / 50.0)
    features = [F.col("p_size").cast("double"), F.col("p_retailprice"), share]
    return table(spark, d, "part").select("p_partkey", "p_size", measures.logistic_risk(features, *MODEL).alias("risk"))


@query(f"SELECT p_partkey, round(risk, 9) AS risk FROM {_RISK}")
def logistic_score(spark, d):
    return _risk(spark, d).select("p_partkey", F.round("risk", 9).alias("risk"))


_DURATION = "CAST(CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size * 1000 + p_partkey % 97 END AS BIGINT)"


@query(f"""WITH m AS (SELECT CASE WHEN risk >= 0.75 THEN 'high' WHEN risk >= 0.5 THEN 'medium' ELSE 'low' END AS band, {_DURATION} AS ms FROM {_RISK}), g AS (SELECT band, list_sort(list(ms)) AS v FROM m WHERE ms IS NOT NULL GROUP BY 1)
SELECT b.band, coalesce(len(v), 0) AS measured, v[greatest(CAST(ceil(len(v) * 0.5) AS BIGINT), 1)] AS median_ms, v[greatest(CAST(ceil(len(v) * 0.9) AS BIGINT), 1)] AS p90_ms FROM (VALUES ('high'), ('medium'), ('low')) b(band) LEFT JOIN g USING (band)""")
def risk_bands(spark, d):
    ms = F.when(F.col("p_partkey") % 6 != 0, F.col("p_size") * 1000 + F.col("p_partkey") % 97).cast("long")
    return measures.risk_bands(_risk(spark, d).withColumn("ms", ms), "risk", "ms")


@query(f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY risk DESC, p_partkey) AS place, p_partkey % 5 <> 0 AS judged, p_size > 30 AS error FROM (SELECT p_partkey, p_size, round(risk, 9) AS risk FROM {_RISK})),
t AS (SELECT count(*) AS n, count(*) FILTER (WHERE judged) AS j, count(*) FILTER (WHERE judged AND error) AS e FROM r), f AS (SELECT fraction::DOUBLE AS fraction, greatest(1, CAST(ceil(n * fraction::DOUBLE) AS BIGINT)) AS reviewed, n, j, e FROM t, (VALUES (0.05), (0.1), (0.2), (0.5)) v(fraction)),
g AS (SELECT fraction, reviewed, j, e, count(*) FILTER (WHERE judged) AS evaluated, count(*) FILTER (WHERE judged AND error) AS captured FROM f JOIN r ON place <= reviewed GROUP BY ALL)
SELECT fraction, reviewed, evaluated, captured, round(captured / nullif(e, 0)::DOUBLE, 6) AS capture_rate, round(captured / nullif(evaluated, 0)::DOUBLE, 6) AS error_yield, round(round(captured / nullif(evaluated, 0)::DOUBLE, 6) / round(nullif(e, 0) / nullif(j, 0)::DOUBLE, 6), 6) AS lift FROM g""")
def lift_buckets(spark, d):
    rows = _risk(spark, d).withColumn("risk", F.round("risk", 9))
    return measures.lift_at(rows, "risk", "p_partkey", F.col("p_size") > 30, F.col("p_partkey") % 5 != 0, [0.05, 0.1, 0.2, 0.5])


_QUALITY = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 3 = 0 THEN 0.999 ELSE 0.9 END::DOUBLE AS probability, CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE 1 - l_discount * 9.5 END AS coverage, CASE WHEN l_suppkey % 2 = 0 THEN 0.85 END::DOUBLE AS uniq,
CASE WHEN l_partkey % 50 = 7 THEN -1 ELSE l_quantity END AS p50, l_quantity * 45 AS p95, l_quantity * 60 AS p99, floor(l_tax * 70000 + 0.5) AS boundary, CASE WHEN l_linenumber = 3 THEN 0.01 ELSE 0.3 END::DOUBLE AS margin, l_partkey % 60 AS anchors, l_suppkey % 5 AS regions,
l_returnflag <> 'N' AS measured, l_linenumber % 2 = 0 AS audio, l_linenumber % 4 = 0 AS visual, l_partkey % 10 = 0 AS manual FROM lineitem)"""


@query(f"""WITH q AS (SELECT *, CASE WHEN p50 < 0 OR regions > 3 THEN 'blocked' WHEN NOT (audio OR visual OR manual) OR coalesce(coverage < 0.2, FALSE) OR p95 > 2000 OR boundary > 5000 OR margin < 0.02 THEN 'blocked'
WHEN coverage IS NOT NULL AND measured AND (manual OR (audio AND visual)) AND probability >= 0.995 AND coverage >= 0.9 AND p95 <= 100 AND p99 <= 500 AND boundary <= 250 AND margin >= 0.25 AND anchors >= 30 AND regions >= 3 AND coalesce(uniq >= 0.8, FALSE) THEN 'verified' ELSE 'review' END AS level FROM {_QUALITY}),
r AS (SELECT level, CASE l_linenumber % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'review' WHEN 2 THEN 'blocked' ELSE 'legacy-unverified' END AS declared FROM q)
SELECT declared, level, CASE WHEN declared IN ('blocked', 'legacy-unverified') THEN declared WHEN declared = 'review' THEN CASE WHEN level = 'blocked' THEN level ELSE declared END ELSE level END AS final, count(*) AS n FROM r GROUP BY ALL""")
def quality_levels(spark, d):
    li, c = table(spark, d, "lineitem"), F.col
    level = measures.quality_level({
        "probability": F.when(c("l_partkey") % 3 == 0, 0.999).otherwise(0.9), "coverage": F.when(c("l_partkey") % 17 != 0, 1 - c("l_discount") * 9.5), "unique_coverage": F.when(c("l_suppkey") % 2 == 0, 0.85),
        "p50": F.when(c("l_partkey") % 50 == 7, F.lit(-1.0)).otherwise(c("l_quantity")), "p95": c("l_quantity") * 45, "p99": c("l_quantity") * 60, "boundary": F.floor(c("l_tax") * 70000 + F.lit(0.5)), "margin": F.when(c("l_linenumber") == 3, 0.01).otherwise(0.3),
        "anchors": c("l_partkey") % 60, "regions": c("l_suppkey") % 5, "measured": c("l_returnflag") != "N", "audio": c("l_linenumber") % 2 == 0, "visual": c("l_linenumber") % 4 == 0, "manual": c("l_partkey") % 10 == 0,
    })
    k = c("l_linenumber") % 4
    declared = F.when(k == 0, "verified").when(k == 1, "review").when(k == 2, "blocked").otherwise("legacy-unverified")
    judged = li.select(declared.alias("declared"), level.alias("level"))
    return judged.groupBy("declared", "level", measures.reconciled_level(F.col("declared"), F.col("level")).alias("final")).agg(F.count(F.lit(1)).alias("n"))

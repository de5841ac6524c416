"""Queries that align sequences made from embeddings and line items."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import affine, assignment, benchmark, editpath
from tidemark.operators.ordering import numbered
from tidemark.plans.collect import collector
from tidemark.session import cut, table

QUERIES, SQL, query = collector()

#: Vectors of a label are frames of 100 ms, in tiles of so many; every other one is the target's.
TILE = 48
RULES = editpath.EditRules(band_ms=900, most_cells=100_000)


def _frames(spark, d):
    rows = table(spark, d, "embeddings").filter("embedding IS NOT NULL AND label IS NOT NULL").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("values"))
    rows = numbered(rows, ["label"], "vec_id", pos="p")
    inside = F.col("p") % TILE
    pair = F.concat_ws("/", "label", F.floor(F.col("p") / TILE))
    return rows.select(pair.alias("pair_id"), F.when(inside % 2 == 0, "source").otherwise("target").alias("side"), (F.floor(inside / 2) * 100).alias("at_ms"), "values", F.lit(1.0).alias("scale"), F.lit(0.0).alias("offset_ms"))


_FRAMES_SQL = f"""f AS (SELECT label || '/' || (p // {TILE}) AS pair_id, p % {TILE} % 2 AS side, p % {TILE} // 2 AS k, v FROM (SELECT label, list_transform(embedding, lambda x: x::DOUBLE) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p FROM embeddings)),
n AS (SELECT pair_id, count(*) FILTER (WHERE side = 0) AS n, count(*) FILTER (WHERE side = 1) AS m FROM f GROUP BY 1),
c AS (SELECT a.pair_id, a.k AS i, list(CASE WHEN abs(a.k - b.k) * 100 <= {RULES.band_ms} THEN floor(greatest(0, least(2, 1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))))) * 1000 + 0.5)::BIGINT END ORDER BY b.k) AS cost
    FROM f a JOIN f b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1 GROUP BY ALL)"""
_BIG = 1 << 40


@query(f"""WITH RECURSIVE {_FRAMES_SQL},
w AS (SELECT pair_id, 0::BIGINT AS i, list_prepend(0::BIGINT, list_transform(range(m), lambda x: {_BIG}::BIGINT)) AS a, list_transform(range(m + 1), lambda x: {_BIG}::BIGINT) AS s, list_prepend({_BIG}::BIGINT, list_transform(range(m), lambda x: (300 + 60 * x)::BIGINT)) AS t FROM n WHERE n > 0 AND m > 0
UNION ALL SELECT pair_id, i + 1, a, s, list_transform(range(len(a)), lambda j: CASE WHEN j = 0 OR cost[j] IS NULL THEN {_BIG} ELSE list_min(list_transform(range(j), lambda k: CASE WHEN cost[k + 1] IS NULL OR k > 0 AND cost[k] IS NULL THEN {_BIG} ELSE least(a[k + 1], s[k + 1]) + 300 + 60 * (j - k - 1) END)) END::BIGINT) FROM (
    SELECT w.pair_id, w.i, cost, list_transform(range(len(a)), lambda j: CASE WHEN j = 0 OR cost[j] IS NULL THEN {_BIG} ELSE least(a[j], s[j], t[j]) + cost[j] END::BIGINT) AS a,
        list_transform(range(len(a)), lambda j: CASE WHEN j = 0 THEN 300 + 60 * w.i WHEN cost[j] IS NULL THEN {_BIG} ELSE least(a[j + 1] + 300, s[j + 1] + 60, t[j + 1] + 300) END::BIGINT) AS s
    FROM w JOIN c ON c.pair_id = w.pair_id AND c.i = w.i))
SELECT pair_id, least(a[m + 1], s[m + 1], t[m + 1]) AS total_cost, CASE WHEN n = 1 THEN 1 ELSE n * 100 END AS source_ms, CASE WHEN m = 1 THEN 1 ELSE m * 100 END AS target_ms FROM w JOIN n USING (pair_id) WHERE w.i = n""")
def edit_costs(spark, d):
    """Total cost of every tile's path, and what its spans cover on both sides."""
    steps = editpath.edit_steps(_frames(spark, d), rules=RULES).filter("fault IS NULL")
    return steps.groupBy("pair_id").agg(F.first("total_cost").alias("total_cost"), F.sum(F.col("source_end") - F.col("source_start")).alias("source_ms"), F.sum(F.col("target_end") - F.col("target_start")).alias("target_ms"))


@query()
def edit_spans(spark, d):
    """Spans of every tile, one-sided ones as far as the way back confirms them."""
    return editpath.two_way_spans(_frames(spark, d), rules=RULES)


#: Clocks of suppliers: the target runs at this scale and offset, one line item in five is wrong.
def _observations(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.unix_date(F.to_date("l_shipdate")).cast("long").alias("day"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = rows.groupBy("l_suppkey", "day").agg(F.min(F.struct(key.alias("key"), "l_quantity")).alias("x")).select("l_suppkey", "day", "x.key", "x.l_quantity")
    scale, offset = F.lit(1) + (F.col("l_suppkey") % 5 - 2) / 100, (F.col("l_suppkey") % 7) * 1000
    source = F.col("day") * 400
    noise = F.when(F.col("key") % 5 == 0, F.col("key") % 9973 * 40 - 200_000).otherwise(F.col("l_quantity") % 7 * 5 - 15)
    target = F.floor(source * scale + offset + noise).cast("long")
    return rows.select(F.col("l_suppkey").alias("pair_id"), F.col("day").alias("source_index"), F.col("key").alias("target_index"), source.alias("source_ms"), target.alias("target_ms"))


@query("SELECT DISTINCT l_suppkey AS pair_id, 1 + (l_suppkey % 5 - 2) / 100.0::DOUBLE AS scale, true AS near, 0::BIGINT AS leaked, true AS tested FROM lineitem")
def affine_models(spark, d):
    """The planted clock of every supplier, and that nothing set aside for the test was fitted."""
    obs = cut(_observations(spark, d))
    lines = cut(affine.tightest_lines(affine.affine_lines(obs, tightest=True)))
    block = F.floor(F.col("source_ms") / affine.BLOCK_MS)
    trained = affine.training_anchors(obs, lines).join(lines.select("pair_id", "held_out_blocks"), "pair_id")
    leaked = trained.groupBy("pair_id").agg(F.count_if(F.array_contains("held_out_blocks", block)).alias("leaked"))
    held = affine.held_out_anchors(obs, lines).groupBy("pair_id").agg((F.count_if("within") * 2 > F.count(F.lit(1))).alias("tested"))
    expected = 1 + (F.col("pair_id") % 5 - 2) / 100
    middle = (F.col("source_start_ms") + F.col("source_end_ms")) / 2
    off = F.col("scale") * middle + F.col("fitted_offset_ms") - (expected * middle + F.col("pair_id") % 7 * 1000)
    return lines.join(leaked, "pair_id").join(held, "pair_id").select("pair_id", F.round("scale", 2).alias("scale"), (F.abs(off) < 20).alias("near"), "leaked", "tested")


_TOLERANCE = 900
_EVENTS = """(SELECT l_orderkey AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, CAST(epoch_ms(l_shipdate) // 86400000 % 40 * 100 AS BIGINT) AS s, CAST(l_quantity * 10 AS BIGINT) AS n, l_partkey % 900 AS t FROM lineitem)"""


def _events(spark, d):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, d, "lineitem").withColumn("i", F.row_number().over(w) - 1)
    start = F.unix_date(F.to_date("l_shipdate")).cast("long") % 40 * 100
    rows = rows.select(F.col("l_orderkey").alias("case_id"), F.col("i").cast("long").alias("index"), start.alias("source_start"), (start + (F.col("l_quantity") * 10).cast("long")).alias("source_end"), (F.col("l_partkey") % 900).alias("target_start"))
    rows = rows.withColumn("target_end", F.col("target_start"))
    return rows.filter("index % 2 = 0"), rows.filter("index % 2 = 1")


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {_EVENTS}),
p AS (SELECT a.case_id, a.i AS g, b.i AS h, greatest(abs(a.s - b.s), abs(a.t - b.t), abs(a.s + a.n - b.s - b.n)) AS worst, abs(a.s - b.s) + abs(a.t - b.t) + abs(a.s + a.n - b.s - b.n) AS total FROM e a JOIN e b USING (case_id) WHERE a.i % 2 = 0 AND b.i % 2 = 1),
q AS (SELECT case_id, g // 2 AS g, list((1 << (h // 2))::BIGINT ORDER BY h) AS bits, list(worst * 16 + total ORDER BY h) AS costs FROM p WHERE worst <= {_TOLERANCE} GROUP BY ALL),
c AS (SELECT case_id, count(*) FILTER (WHERE i % 2 = 0) AS golds FROM e GROUP BY 1),
s AS (SELECT case_id, golds, 0::BIGINT AS g, 0::BIGINT AS used, 0::BIGINT AS cost FROM c
UNION ALL SELECT case_id, golds, g + 1, used, min(cost) FROM (
    SELECT case_id, golds, s.g, s.used | unnest(list_prepend(0::BIGINT, coalesce(bits, []))) AS used, s.cost + unnest(list_prepend(0::BIGINT, coalesce(costs, []))) AS cost, s.used AS before, unnest(list_prepend(0::BIGINT, coalesce(bits, []))) AS bit
    FROM s LEFT JOIN q USING (case_id, g) WHERE s.g < golds) WHERE before & bit = 0 GROUP BY ALL),
b AS (SELECT case_id, min((-bit_count(used), cost)) AS best FROM s WHERE g = golds GROUP BY 1)
SELECT case_id, (-best[1])::BIGINT AS tp, count(*) FILTER (WHERE i % 2 = 1) + best[1] AS fp, count(*) FILTER (WHERE i % 2 = 0) + best[1] AS fn, best[2]::BIGINT AS cost FROM e JOIN b USING (case_id) GROUP BY case_id, best""")
def event_matching(spark, d):
    """Events of an order that stand for each other, and what the best matching costs."""
    gold, predicted = _events(spark, d)
    matches = cut(assignment.match_events(gold, predicted, ["case_id"], _TOLERANCE))
    cost = matches.filter("within").groupBy("case_id").agg(F.sum(F.col("worst_ms") * assignment.WORST_WEIGHT + F.col("sum_ms")).alias("cost"))
    return assignment.event_counts(gold, predicted, matches, ["case_id"]).join(cost, "case_id", "left").withColumn("cost", F.coalesce("cost", F.lit(0)))


_CHOICES = """(SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, l_discount * 8 * (0.35::DOUBLE + l_quantity / 50 * 0.65::DOUBLE) + l_tax * 0.2::DOUBLE - CASE WHEN l_returnflag = 'R' THEN 0.3::DOUBLE ELSE 0 END AS worth,
l_partkey % 2 AS a, l_suppkey % 2 AS b, l_partkey % 50 * 100 AS s0, l_partkey % 50 * 100 + CAST(l_quantity * 30 AS BIGINT) + 100 AS s1, l_suppkey % 50 * 100 AS t0, l_suppkey % 50 * 100 + CAST(l_quantity * 30 AS BIGINT) + 100 AS t1, CASE WHEN l_linestatus = 'O' THEN l_linenumber % 3 END AS alt, l_linenumber AS o, l_returnflag = 'A' AND l_linestatus = 'F' AS blocked FROM lineitem)"""


@query(f"""WITH RECURSIVE c AS (SELECT * FROM {_CHOICES} WHERE NOT blocked), h AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY worth DESC, id) AS k FROM c),
x AS (SELECT y.g, y.k, list(z.k) FILTER (WHERE (y.alt IS NOT NULL AND y.alt = z.alt) OR (y.a = z.a AND least(y.s1, z.s1) - greatest(y.s0, z.s0) > 250) OR (y.b = z.b AND least(y.t1, z.t1) - greatest(y.t0, z.t0) > 250)) AS bad,
    list(z.k) FILTER (WHERE (y.a = z.a AND sign(y.s0 - z.s0) * sign(y.o - z.o) < 0) OR (y.b = z.b AND sign(y.t0 - z.t0) * sign(y.o - z.o) < 0)) AS turn FROM h y JOIN h z ON y.g = z.g AND z.k < y.k GROUP BY ALL),
s AS (SELECT g, 0::BIGINT AS k, []::BIGINT[] AS chosen, 0.0::DOUBLE AS score FROM (SELECT DISTINCT g FROM h)
UNION ALL SELECT g, k + 1, unnest(CASE WHEN fits THEN [chosen, list_append(chosen, k + 1)] ELSE [chosen] END), unnest(CASE WHEN fits THEN [score, score + gain] ELSE [score] END) FROM (
    SELECT s.g, s.k, chosen, score, gain, gain > 0 AND NOT coalesce(list_has_any(bad, chosen), false) AS fits FROM (SELECT s.*, h.worth - 0.08::DOUBLE * len(list_intersect(coalesce(turn, []), chosen)) AS gain, bad FROM s JOIN h ON h.g = s.g AND h.k = s.k + 1 LEFT JOIN x ON x.g = s.g AND x.k = s.k + 1) s)),
n AS (SELECT g, max(k) AS n FROM h GROUP BY 1)
SELECT g AS group_id, round(max(score), 9) AS score FROM s JOIN n USING (g) WHERE k = n GROUP BY 1""")
def match_choices(spark, d):
    """The worth of the best combination of every order's hypotheses."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, d, "lineitem").withColumn("id", F.row_number().over(w))
    worth = assignment.hypothesis_weight(F.col("l_discount") * 8, F.col("l_quantity") / 50, F.col("l_tax"), F.col("l_returnflag") == "R")
    length = (F.col("l_quantity") * 30).cast("long") + 100
    starts = [F.col(c) % 50 * 100 for c in ("l_partkey", "l_suppkey")]
    order = F.col("l_linenumber").cast("double")
    blocked = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")
    rows = rows.select(
        F.col("l_orderkey").alias("group_id"), "id", worth.alias("worth"), (F.col("l_partkey") % 2).alias("source"), (F.col("l_suppkey") % 2).alias("target"), starts[0].alias("source_start"), (starts[0] + length).alias("source_end"), starts[1].alias("target_start"), (starts[1] + length).alias("target_end"),
        F.when(F.col("l_linestatus") == "O", F.col("l_linenumber") % 3).cast("string").alias("alternative"), order.alias("source_order"), order.alias("target_order"), blocked.alias("blocked"),
    ).filter("NOT blocked")
    return assignment.choose(rows).groupBy("group_id").agg(F.round(F.max("score"), 9).alias("score"))


def _cases(spark, d):
    """Orders as annotated relations: their lines are anchors or edits, and predictions are these, a little moved."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    cases = o.select(key.alias("case_id"), F.when(key % 10 < 8, "real").otherwise("synthetic").alias("media_kind"), F.when(key % 3 == 0, "frozen-test").otherwise("development").alias("split"), F.lit(400).cast("long").alias("tolerance_ms"), F.lit(0).cast("long").alias("source_start"), (F.lit(100_000) + key % 7 * 500_000).alias("source_end"), F.when(key % 4 == 0, 500).otherwise(0).cast("long").alias("target_start"), (key % 2 == 0).alias("same_media"))
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, d, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").withColumn("i", F.row_number().over(w) - 1)
    at = F.col("i") * 10_000
    kind = F.when(F.col("l_returnflag") == "A", "sourceOnly").when(F.col("l_linestatus") == "F", "targetOnly").otherwise("ambiguous")
    anchors = rows.filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("case_id"), at.cast("long").alias("source_ms"), (at + F.col("l_partkey") % 5 * 10).cast("long").alias("target_ms"))
    edits = rows.filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("case_id"), kind.alias("kind"), F.col("i").alias("index"), at.cast("long").alias("source_start"), (at + F.when(kind == "targetOnly", 0).otherwise(2000)).cast("long").alias("source_end"), at.cast("long").alias("target_start"), (at + F.when(kind == "sourceOnly", 0).otherwise(2000)).cast("long").alias("target_end"))
    moved = F.when(F.col("case_id") % 5 == 0, 700).otherwise(F.col("case_id") % 3 * 100)
    spans = edits.select(F.col("case_id").alias("map_id"), F.col("index").alias("span_index"), "kind", *[(F.col(c) + moved).cast("long").alias(c) for c in assignment.SPAN])
    return cases, anchors, edits, cases.filter("case_id % 17 <> 0").select("case_id"), spans.filter("map_id % 17 <> 0")


_CASES = """e AS (SELECT l_orderkey AS c, i * 10000 AS s, l_returnflag AS r, l_linestatus AS f, l_partkey % 5 * 10 AS o, CASE WHEN l_returnflag = 'A' THEN 'source-only' WHEN l_linestatus = 'F' THEN 'target-only' ELSE 'ambiguous' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem)),
n AS (SELECT o_orderkey AS c, count(*) FILTER (WHERE r <> 'N') AS edits, arg_min(o, s) FILTER (WHERE r = 'N') AS a, arg_max(o, s) FILTER (WHERE r = 'N') AS b, min(s) FILTER (WHERE r = 'N') AS sa, max(s) FILTER (WHERE r = 'N') AS sb FROM orders LEFT JOIN e ON e.c = o_orderkey GROUP BY 1),
t AS (SELECT DISTINCT c, kind AS scenario FROM e WHERE r <> 'N' AND c IN (SELECT o_orderkey FROM orders) UNION ALL SELECT c, 'multi-edit' FROM n WHERE edits > 1 UNION ALL SELECT c, 'global-offset' FROM n WHERE c % 4 = 0 OR a <> 0 UNION ALL SELECT c, 'time-stretch' FROM n WHERE edits = 0 AND sb > sa AND a <> b UNION ALL SELECT c, 'long-reference' FROM n WHERE 100000 + c % 7 * 500000 >= 2700000)"""


@query(f"WITH {_CASES} SELECT c AS case_id, scenario FROM t UNION ALL SELECT c, 'codec-variant' FROM n WHERE c % 2 = 1 AND c NOT IN (SELECT c FROM t)")
def benchmark_scenarios(spark, d):
    cases, anchors, gold, *_ = _cases(spark, d)
    return benchmark.scenarios(cases, anchors, gold)


@query(f"""WITH {_CASES}, k AS (SELECT c, count(*) AS g FROM e WHERE r <> 'N' AND c IN (SELECT o_orderkey FROM orders) GROUP BY 1)
SELECT CASE WHEN n.c % 17 = 0 THEN 'missing' WHEN n.c % 5 = 0 THEN 'far' ELSE 'near' END AS "group", count(*) AS cases, CAST(sum(CASE WHEN n.c % 17 <> 0 AND n.c % 5 <> 0 THEN coalesce(g, 0) ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN n.c % 17 <> 0 AND n.c % 5 = 0 THEN coalesce(g, 0) ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN n.c % 17 = 0 OR n.c % 5 = 0 THEN coalesce(g, 0) ELSE 0 END) AS BIGINT) AS fn FROM n LEFT JOIN k ON k.c = n.c GROUP BY 1""")
def benchmark_edits(spark, d):
    """Edits that predictions meet, in cases whose predictions are near, far off or missing."""
    tables = _cases(spark, d)
    results, _ = benchmark.case_results(*tables)
    kind = F.when(F.col("case_id") % 17 == 0, "missing").when(F.col("case_id") % 5 == 0, "far").otherwise("near")
    return results.groupBy(kind.alias("group")).agg(F.count(F.lit(1)).alias("cases"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


@query()
def benchmark_gate(spark, d):
    cases, anchors, gold, predicted, spans = _cases(spark, d)
    results, errors = benchmark.case_results(cases, anchors, gold, predicted, spans)
    return benchmark.gate(cases, benchmark.scenarios(cases, anchors, gold), cut(results), cut(errors), predicted)

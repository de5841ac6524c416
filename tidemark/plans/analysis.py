"""Queries over features, reviews and the project library."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import titles
from tidemark.operators import hints, lookup, matching, measures, review
from tidemark.plans import bindings as B
from tidemark.plans.collect import collector
from tidemark.session import cut, ship_package, table

QUERIES, SQL, query = collector()

_BITS = "(SELECT vec_id, bit_or(CASE WHEN x::DOUBLE > m THEN 1::UBIGINT << (k - 1) ELSE 0::UBIGINT END) AS bits FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(1, 65)) AS k, (list_sort(embedding)[32]::DOUBLE + list_sort(embedding)[33]::DOUBLE) / 2 AS m FROM embeddings) GROUP BY vec_id)"


_NEAR = f"(SELECT vec_id, bits FROM {_BITS} UNION ALL SELECT -1 - vec_id, xor(bits, ((1::UBIGINT << (vec_id % 61)) * 5) & 18446744073709551615::UBIGINT) FROM {_BITS} WHERE vec_id % 10 = 0)"


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.bits, b.bits)) AS INTEGER) AS distance FROM {_NEAR} a JOIN {_NEAR} b ON a.vec_id < b.vec_id AND bit_count(xor(a.bits, b.bits)) <= 10")
def phash_hamming_pairs(spark, d):
    """Hashes of all vectors, and of copies of every tenth with one or two bits turned."""
    rows = table(spark, d, "embeddings").select("vec_id", matching.median_bits(F.col("embedding")).alias("bits"))
    turned = F.call_function("shiftleft", F.lit(5).cast("bigint"), (F.col("vec_id") % 61).cast("int"))
    copies = rows.filter("vec_id % 10 = 0").select((-1 - F.col("vec_id")).alias("vec_id"), F.col("bits").bitwiseXOR(turned).alias("bits"))
    return matching.hamming_pairs(rows.union(copies), "vec_id", "bits", 10)


@query("""WITH q AS (SELECT vec_id, embedding AS v, floor(embedding[1]::DOUBLE / 0.125) AS q0, floor(embedding[2]::DOUBLE / 0.125) AS q1, floor(embedding[3]::DOUBLE / 0.125) AS q2, floor(embedding[4]::DOUBLE / 0.125) AS q3 FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) / 64), 6) AS distance FROM q a JOIN q b USING (q0, q1, q2, q3) WHERE a.vec_id < b.vec_id)
SELECT * FROM p WHERE distance <= 0.15""")
def fingerprint_join(spark, d):
    return matching.fingerprint_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.125, 0.15)


_KEPT = f"""(WITH p AS (SELECT user_id, t_ms, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY t_ms, event_id) - 1 AS i FROM {B.E_SQL} WHERE event_type = 'purchase'),
k AS (SELECT DISTINCT user_id, CAST(floor(k * ((n - 1) / 31.0::DOUBLE) + 0.5) AS BIGINT) AS i FROM p, range(0, 32) r(k) WHERE n > 32) SELECT user_id, t_ms FROM p WHERE n <= 32 OR (user_id, i) IN (SELECT (user_id, i) FROM k))"""


@query(f"""SELECT bucket, n FROM (SELECT bucket, n, row_number() OVER (ORDER BY n DESC, bucket) AS rn FROM (SELECT (b.t_ms - a.t_ms) // 60000 AS bucket, count(*) AS n FROM {B.E_SQL} a JOIN {_KEPT} b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.t_ms >= a.t_ms GROUP BY 1)) WHERE rn <= 24 AND (n >= 2 OR rn <= 8)""")
def offset_histogram(spark, d):
    """The 24 most frequent offsets; ones that occur once only among the first 8.  A key has 32 targets at most, evenly spaced."""
    e = B.events(spark, d)
    a = e.filter("event_type = 'view'").select("user_id", F.col("t_ms").alias("s"))
    b = lookup.even_sample(e.filter("event_type = 'purchase'"), ["user_id"], ["t_ms", "event_id"], 32).select("user_id", F.col("t_ms").alias("t"))
    pairs = a.join(b, "user_id").filter("t >= s").groupBy(F.floor((F.col("t") - F.col("s")) / 60000).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    top = pairs.orderBy(F.desc("n"), "bucket").limit(24)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "bucket"))).filter("n >= 2 OR place <= 8").drop("place")


@query("SELECT l_suppkey, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS scale, round(regr_intercept(l_extendedprice, l_quantity), 2) AS shift, round(corr(l_extendedprice, l_quantity), 6) AS fit FROM lineitem GROUP BY l_suppkey")
def affine_fit(spark, d):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope(y, x), 4).alias("scale"), F.round(F.regr_intercept(y, x), 2).alias("shift"), F.round(F.corr(y, x), 6).alias("fit"))


@query("SELECT l_returnflag, count(*) AS n, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, max(l_extendedprice) AS most FROM lineitem GROUP BY l_returnflag")
def nearest_rank_percentiles(spark, d):
    n = F.col("n")
    places = {"p50": measures.nearest_index(0.5, n), "p95": measures.nearest_index(0.95, n), "most": n - 1}
    return measures.values_at_ranks(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", places)


@query("SELECT DISTINCT o_orderstatus || '-' || o_orderpriority AS cell, count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS n, round(count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) * count(*) OVER () / (count(*) OVER (PARTITION BY o_orderstatus) * (count(*) OVER (PARTITION BY o_orderpriority))::DOUBLE), 6) AS lift FROM orders")
def lift_table(spark, d):
    return review.lift(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").select(F.concat_ws("-", "o_orderstatus", "o_orderpriority").alias("cell"), "n", F.round("lift", 6).alias("lift"))


@query("SELECT c_custkey, CAST(('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT % 100 AS BIGINT) AS bucket, CASE WHEN ('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT % 100 < 80 THEN 'train' WHEN ('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT % 100 < 90 THEN 'tune' ELSE 'test' END AS part FROM customer")
def hash_split(spark, d):
    return review.hash_split(table(spark, d, "customer"), "c_custkey").select("c_custkey", "bucket", "part")


@query("SELECT c_mktsegment, c_custkey, CAST(ntile(5) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS band, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS place FROM customer")
def risk_rank(spark, d):
    w = W.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").select("c_mktsegment", "c_custkey", F.ntile(5).over(w).alias("band"), F.row_number().over(w).alias("place"))


@query("""SELECT tp, fp, fn, tn, round(p::DOUBLE, 6) AS precision_, round(r::DOUBLE, 6) AS recall_, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END::DOUBLE, 6) AS f1 FROM (SELECT *,
CASE WHEN tp + fp = 0 THEN CASE WHEN fn = 0 THEN 1 ELSE 0 END ELSE tp / (tp + fp)::DOUBLE END AS p, CASE WHEN tp + fn = 0 THEN CASE WHEN fp = 0 THEN 1 ELSE 0 END ELSE tp / (tp + fn)::DOUBLE END AS r FROM
(SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fn, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tn FROM labels))""")
def prf_metrics(spark, d):
    return review.prf(table(spark, d, "labels"), F.col("quality") == 0, F.col("toxic") == 1)


_VOTES = "(SELECT o_orderkey AS seen, o_custkey % 5 AS reviewer, o_orderkey // 6 AS subject, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 END AS vote, CASE WHEN o_custkey % 4 = 0 THEN 'adjudicator' ELSE 'independent' END AS role FROM orders)"


@query(f"""WITH l AS (SELECT subject, reviewer, vote FROM (SELECT *, row_number() OVER (PARTITION BY subject, reviewer ORDER BY seen DESC) AS rn FROM {_VOTES} WHERE role = 'independent') WHERE rn = 1),
p AS (SELECT subject, count(*) AS votes, count(vote) AS decided, min(vote) AS low, max(vote) AS high FROM l GROUP BY 1),
a AS (SELECT subject, arg_max(vote, seen) AS ruling FROM {_VOTES} v WHERE role = 'adjudicator' AND vote IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l WHERE l.subject = v.subject AND l.reviewer = v.reviewer) GROUP BY 1),
s AS (SELECT DISTINCT subject FROM {_VOTES}), x AS (SELECT subject, coalesce(votes, 0) AS votes, decided, low, high, ruling FROM s LEFT JOIN p USING (subject) LEFT JOIN a USING (subject))
SELECT subject, votes, CASE WHEN votes >= 2 AND decided = votes AND low = high THEN 'gold' WHEN votes >= 2 AND low <> high THEN CASE WHEN ruling IS NULL THEN 'conflict' ELSE 'gold' END ELSE 'awaiting-independent' END AS state,
CASE WHEN votes >= 2 AND decided = votes AND low = high THEN low WHEN votes >= 2 AND low <> high THEN ruling END AS decision,
CASE WHEN votes >= 2 AND decided = votes AND low = high THEN 'independentAgreement' WHEN votes >= 2 AND low <> high AND ruling IS NOT NULL THEN 'adjudicator' END AS resolution FROM x""")
def vote_adjudication(spark, d):
    vote = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    role = F.when(F.col("o_custkey") % 4 == 0, "adjudicator").otherwise("independent")
    votes = table(spark, d, "orders").select(F.col("o_orderkey").alias("seen"), (F.col("o_custkey") % 5).alias("reviewer"), F.floor(F.col("o_orderkey") / 6).alias("subject"), vote.alias("vote"), role.alias("role"))
    return review.adjudicate(votes, "subject", "reviewer", "seen", "vote", "role")


@query("""WITH RECURSIVE e AS (SELECT 100 + c_custkey AS a, c_nationkey AS b FROM customer UNION SELECT 1000000000 + s_suppkey, s_nationkey FROM supplier UNION SELECT n_nationkey, -1 - n_regionkey FROM nation WHERE n_nationkey % 2 = 0),
x AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e), r AS (SELECT u AS id, u AS c FROM x WHERE u < 25 UNION SELECT x.v, r.c FROM r JOIN x ON x.u = r.id) SELECT id::BIGINT AS id, min(c)::BIGINT AS family FROM r GROUP BY id""")
def media_families(spark, d):
    """Families of customers and suppliers over their nations, of which the even ones of a region belong together."""
    c = table(spark, d, "customer").select((F.col("c_custkey") + 100).alias("a"), F.col("c_nationkey").cast("long").alias("b"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("a"), F.col("s_nationkey").cast("long").alias("b"))
    n = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("a"), (-1 - F.col("n_regionkey")).cast("long").alias("b"))
    return review.families(c.union(s).union(n))


def _links(spark, d):
    """All orders and line items as links of customers, orders and suppliers, whose ids never meet."""
    o = table(spark, d, "orders").select((3 * F.col("o_custkey")).alias("a"), (3 * F.col("o_orderkey") + 1).alias("b"))
    li = table(spark, d, "lineitem").select((3 * F.col("l_suppkey") + 2).alias("a"), (3 * F.col("l_orderkey") + 1).alias("b"))
    return o.union(li).filter("a IS NOT NULL AND b IS NOT NULL")


@query()
def media_families_whole(spark, d):
    """Families over all orders and lineitem."""
    return review.whole_families(_links(spark, d))


@query("""WITH e AS (SELECT 3 * o_custkey AS a, 3 * o_orderkey + 1 AS b FROM orders UNION ALL SELECT 3 * l_suppkey + 2, 3 * l_orderkey + 1 FROM lineitem)
SELECT count(DISTINCT x) AS ids, 0::BIGINT AS torn, 0::BIGINT AS misnamed FROM (SELECT a AS x FROM e UNION ALL SELECT b FROM e)""")
def media_families_hold(spark, d):
    """All ids have a family, no link joins two, and each is named after its smallest id."""
    found = cut(review.whole_families(_links(spark, d)))
    a, b = (found.select(F.col("id").alias(x), F.col("family").alias(f"family_{x}")) for x in "ab")
    torn = _links(spark, d).join(a, "a").join(b, "b").agg(F.count_if(F.col("family_a") != F.col("family_b")).alias("torn"))
    named = found.groupBy("family").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    totals = named.agg(F.sum("n").alias("ids"), F.count_if(F.col("least") != F.col("family")).alias("misnamed"))
    return totals.crossJoin(torn).select("ids", "torn", "misnamed")


@query("SELECT o_orderkey, o_orderdate FROM (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1996-06-01', 500000)) WHERE rn <= 50")
def keyset_page(spark, d):
    o = table(spark, d, "orders")
    at = F.lit("1996-06-01").cast("timestamp")
    before = (F.col("o_orderdate") < at) | ((F.col("o_orderdate") == at) & (F.col("o_orderkey") < 500_000))
    return o.filter(before).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS head FROM orders) WHERE o_orderstatus = 'O' OR head = 1 OR rn <= 3")
def revision_retention(spark, d):
    by = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    protected = F.col("o_orderstatus") == "O"
    rows = table(spark, d, "orders").withColumns({"head": F.row_number().over(W.partitionBy("o_custkey").orderBy(*by)), "rn": F.row_number().over(W.partitionBy("o_custkey", protected).orderBy(*by))})
    return rows.filter(protected | (F.col("head") == 1) | (F.col("rn") <= 3)).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, o_orderkey, count(*) AS lines FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY ALL")
def recovery_join(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").groupBy("c_custkey", "o_orderkey").agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT o_orderkey AS key, CASE WHEN b IS NULL THEN 'delete' WHEN a IS NULL THEN 'insert' WHEN a <> b THEN 'update' ELSE 'keep' END AS action FROM (SELECT o_orderkey, o_orderstatus AS a FROM orders WHERE o_orderkey % 3 <> 0) FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS b FROM orders WHERE o_orderkey % 2 = 0) USING (o_orderkey)")
def library_diff(spark, d):
    o = table(spark, d, "orders")
    held = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("a"))
    wanted = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("b"))
    return review.diff(held, wanted, "key", "a", "b")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal > 0)")
def orphan_cleanup(spark, d):
    """References whose item still exists."""
    items = table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING' AND c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(items, "o_custkey", "left_semi")


@query("SELECT s_suppkey, n_nationkey FROM supplier CROSS JOIN nation WHERE (s_nationkey % 4 = 0 OR n_regionkey = s_nationkey % 5) AND (s_acctbal < 0 OR abs(s_nationkey - n_nationkey) <= 3)")
def pair_prune(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    season = (F.col("s_nationkey") % 4 == 0) | (F.col("n_regionkey") == F.col("s_nationkey") % 5)
    reach = (F.col("s_acctbal") < 0) | (F.abs(F.col("s_nationkey") - F.col("n_nationkey")) <= 3)
    return s.join(n, season & reach).select("s_suppkey", "n_nationkey")


@query("SELECT item_id, lower(lpad(to_hex(((item_id * 7919) & 255) << 16 | ((item_id * 7919) & 65280) | (((item_id * 7919) >> 16) & 255)), 6, '0')) AS bgr, printf('%02d:%02d:%02d.%03d', item_id * 37123 // 3600000, item_id * 37123 // 60000 % 60, item_id * 37123 // 1000 % 60, item_id * 37123 % 1000) AS stamp FROM benchmark")
def comment_fields(spark, d):
    i = F.col("item_id")
    return table(spark, d, "benchmark").select("item_id", F.lower(X.rgb_to_bgr_hex(i * 7919)).alias("bgr"), X.ms_to_timecode(i * 37123).alias("stamp"))


@query("SELECT conv_id, turn // 2 AS bucket, count(*) AS hits, CAST(sum(w) AS BIGINT) AS score FROM (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\\bthe\\b') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\\band\\b') THEN 2 ELSE 0 END AS w FROM conversations) WHERE w > 0 GROUP BY ALL")
def hint_clusters(spark, d):
    weight = F.when(F.col("text").rlike(r"(?i)\bthe\b"), 3).otherwise(0) + F.when(F.col("text").rlike(r"(?i)\band\b"), 2).otherwise(0)
    rows = table(spark, d, "conversations").withColumn("w", weight).filter("w > 0")
    return rows.groupBy("conv_id", F.floor(F.col("turn") / 2).alias("bucket")).agg(F.count(F.lit(1)).alias("hits"), F.sum("w").alias("score"))


@query("SELECT * FROM (SELECT conv_id, hits, score, CASE WHEN hits >= 5 OR score >= 12 THEN 'high' WHEN hits >= 3 OR score >= 7 THEN 'medium' ELSE 'low' END AS level, row_number() OVER (ORDER BY score DESC, hits DESC, conv_id) AS place FROM (SELECT conv_id, count(*) AS hits, CAST(sum(w) AS BIGINT) AS score FROM (SELECT conv_id, CASE WHEN regexp_matches(text, '(?i)\\bthe\\b') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\\band\\b') THEN 2 ELSE 0 END AS w FROM conversations) WHERE w > 0 GROUP BY conv_id HAVING count(*) >= 2)) WHERE place <= 12")
def hint_clusters_top12(spark, d):
    per = hint_clusters(spark, d).groupBy("conv_id").agg(F.sum("hits").alias("hits"), F.sum("score").alias("score")).filter("hits >= 2")
    level = F.when((F.col("hits") >= 5) | (F.col("score") >= 12), "high").when((F.col("hits") >= 3) | (F.col("score") >= 7), "medium").otherwise("low")
    top = per.orderBy(F.desc("score"), F.desc("hits"), "conv_id").limit(12)
    return top.withColumn("level", level).withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), F.desc("hits"), "conv_id")).cast("long")).select("conv_id", "hits", "score", "level", "place")


@query()
def lis_path(spark, d):
    ship_package(spark)
    rows = table(spark, d, "lineitem").select("l_suppkey", F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("source"), F.col("l_partkey").alias("target"))
    return matching.increasing_path(rows, "l_suppkey", "source", "target")


_RULES = hints.keyword_rules("tion, ment；heit|Ción")
_FOUND = ", ".join(f"CASE WHEN contains(lower(text), lower('{r.label}')) THEN ['{r.label}'] ELSE [] END" for r in _RULES)


@query(f"""WITH h AS (SELECT conv_id, turn, turn * 20000 AS t, text, flatten([{_FOUND}]) AS k FROM conversations), g AS (SELECT conv_id, t // 60000 AS bucket, count(*) AS hits, CAST(sum(len(k) * 2) AS BIGINT) AS score, list(t ORDER BY t, turn) AS ts, flatten(list(k ORDER BY t, turn)) AS w FROM h WHERE len(k) > 0 GROUP BY ALL HAVING count(*) >= 2)
SELECT conv_id AS asset_id, bucket, hits, score, ts[hits // 2 + 1] AS middle_ms, array_to_string(list_sort(list_distinct(w)), '|') AS keywords FROM g ORDER BY score DESC, middle_ms, conv_id, bucket LIMIT 12""")
def suspected_cuts(spark, d):
    """The clusters of turns that hint most, by rules made of keywords."""
    items = table(spark, d, "conversations").select(F.col("conv_id").alias("asset_id"), F.col("turn").alias("original_index"), (F.col("turn") * 20_000).alias("at_ms"), "text")
    found = hints.suspected_cuts(items, _RULES)
    return found.select("asset_id", "bucket", "hits", "score", "middle_ms", F.array_join(F.array_sort(F.split("keywords", r"\|")), "|").alias("keywords"))


@query("""SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) || '|' || (1990 + p_size) || CASE WHEN p_size % 2 = 0 THEN '|movie' ELSE '|tv' END || CASE WHEN p_size % 4 <> 1 THEN '|s' || (p_size % 4) ELSE '' END || '|' || (p_partkey % 30 + 1) AS key,
'title-' || substr(sha256(CASE WHEN p_size % 2 = 0 THEN 'movie' ELSE 'tv' END || ':' || regexp_replace(lower(p_name || 'mkv'), '[^a-z0-9]+', '', 'g') || ':' || (1990 + p_size)), 1, 48) AS work, p_size AS season, p_partkey % 30 + 1 AS episode FROM part WHERE p_size % 4 > 0""")
def title_keys(spark, d):
    p = table(spark, d, "part").filter("p_size % 4 > 0")
    name, kind, year, episode = F.concat("p_name", F.lit(".mkv")), F.when(F.col("p_size") % 2 == 0, "movie").otherwise("tv"), F.col("p_size") + 1990, F.col("p_partkey") % 30 + 1
    shown = F.concat("p_name", F.lit(" S"), F.col("p_size").cast("string"), F.lit("E"), episode.cast("string"), F.lit(".mkv"))
    rows = p.select("p_partkey", titles.resource_key(name, year, kind, F.col("p_size") % 4, episode).alias("key"), titles.work_key(name, kind, year).alias("work"), titles.library_episode(shown).alias("e"))
    return rows.select("p_partkey", "key", "work", F.col("e.season").cast("int").alias("season"), F.col("e.episode").alias("episode"))


@query("""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey % 3 AS d, o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 100 / 100.0::DOUBLE END AS risk, o_orderkey % 4000 AS b FROM orders),
l AS (SELECT c, max(k) AS k, count(*) - 1 AS revisions FROM o GROUP BY 1), r AS (SELECT o.*, revisions FROM l JOIN o USING (c, k)),
f AS (SELECT r.k, r.revisions, r.d, r.risk, bool_or(p.k <> r.k AND p.d <> r.d) AS changed, max(CASE WHEN p.k <> r.k THEN abs(p.b - r.b) ELSE 0 END) AS drift FROM r JOIN o p ON p.c = r.c GROUP BY ALL),
s AS (SELECT *, k % 7 = 0 AS gold, CASE WHEN k % 7 = 1 THEN 100 ELSE 0 END + CASE WHEN changed THEN 55 ELSE 0 END + CASE WHEN drift > 1000 THEN 35 ELSE 0 END + CASE WHEN d = 0 THEN 28 ELSE 0 END + 22 + least(12, revisions * 4) + coalesce(risk * 30, 0) AS x FROM f)
SELECT k AS record_id, CASE WHEN gold THEN 0 ELSE floor(x * 10 + 0.5::DOUBLE) / 10 END AS score, CASE WHEN gold THEN 'gold' WHEN floor(x * 10 + 0.5::DOUBLE) / 10 >= 90 THEN 'critical' WHEN floor(x * 10 + 0.5::DOUBLE) / 10 >= 50 THEN 'high' ELSE 'normal' END AS level, revisions, changed, drift AS drift_ms FROM s""")
def active_review(spark, d):
    """Orders as revisions of their customers' records, by how urgent another look is."""
    k, zero = F.col("o_orderkey"), F.lit(0).cast("long")
    none = F.lit(None).cast("double")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("c"), k.alias("record_id"), F.when(k % 3 == 0, "unresolved").when(k % 3 == 1, "matched").otherwise("ambiguous").alias("decision"), F.lit("rough").alias("precision"), zero.alias("tolerance_ms"), zero.alias("source_start"), (k % 4000).alias("source_end"), zero.alias("target_start"), zero.alias("target_end"), F.when(k % 5 != 0, k % 100 / 100).alias("difference_risk"), none.alias("ambiguous"), none.alias("visual_ambiguous"), none.alias("margin"), none.alias("model_risk"))
    states = table(spark, d, "orders").select(k.alias("record_id"), F.when(k % 7 == 0, "gold").when(k % 7 == 1, "conflict").otherwise("awaiting-independent").alias("state"))
    return review.active_review(rows, states, ["c"], ["record_id"])

"""Queries over rule texts that are put together from orders: one text per customer, one line per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.operators import merging
from tidemark.plans import bindings as B
from tidemark.plans.collect import collector
from tidemark.session import table
from tidemark.sources import comments

QUERIES, SQL, query = collector()

#: Lines by order number: what is in braces stands for a small number from the order (a to 9, b to 79, c to 999).
DURATION_LINES = ["S0{a}E{b} {b}:20.{c}", "第{a}季第{b}集：{b}分钟", "E{b}={a}.5", "{a}:{b}:{b}", "special {b} min", "{b}", "第{b}話 {b}:5", "bad line", "x {a}:{b}:07.{c}  ", "  ", "E{b} = 3m", "0:00"]
CUT_LINES = ["{a}:{b}", "{b}，{a}:0{a}；{b}", "{a}:{b}:{b}.{c}", "x{a};{b}MIN", "{b}.{c} 分", ",;", "-{a}:10", "{b}:1{a}"]
ANCHOR_LINES = ["0:{b} -> {a}:{b}.{c}", "{b}:0{a},{a}:{b}:0{a}", "# {a}:10 -> 1:10", "{a}:{b} → 0{a}:{b}", "{b} => {a}", "{a}:10", "1:10 -> 2:20 -> 3:30", "{a}:1{a}=>0x{a}:{a}"]
_NUMBERS = ["{b}", " {a}.{c} ", "{a}e{a}", "0x{b}", "{a}d", "", "0b10{a}", "-{b}.", "{c}L", ".{c}", "1_{a}", "+{b}"]


def _line(forms: list[str], key: str = "o_orderkey") -> F.Column:
    pick = F.element_at(F.array(*map(F.lit, forms)), (F.col(key) % len(forms) + 1).cast("int"))
    for name, n, by in (("{a}", 10, 7), ("{b}", 80, 11), ("{c}", 1000, 13)):
        pick = F.replace(pick, F.lit(name), (F.floor(F.col(key) / by) % n).cast("string"))
    return pick


def _line_sql(forms: list[str], key: str = "o_orderkey") -> str:
    pick = f"[{', '.join(f"'{x}'" for x in forms)}][{key} % {len(forms)} + 1]"
    for name, n, by in (("{a}", 10, 7), ("{b}", 80, 11), ("{c}", 1000, 13)):
        pick = f"replace({pick}, '{name}', ({key} // {by} % {n})::VARCHAR)"
    return pick


def _texts(spark, d, forms):
    rows = table(spark, d, "orders").select("o_custkey", F.struct("o_orderkey", _line(forms).alias("line")).alias("x"))
    return rows.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))


_N = "TRY_CAST(regexp_extract({0}, '^[0-9.]+') AS DOUBLE)"
#: A time of a rule text, and of an anchor, as SQL over t without blanks.
_CLOCK = r"""(CASE WHEN regexp_matches(t, '^(-0|[0-9]+):[0-9.]+$') AND split_part(t, ':', 2)::DOUBLE < 60 THEN split_part(t, ':', 1)::DOUBLE * 60 + split_part(t, ':', 2)::DOUBLE
WHEN regexp_matches(t, '^0x[0-9]+:[0-9.]+$') THEN split_part(t, ':', 1)[3:]::DOUBLE * 60 + split_part(t, ':', 2)::DOUBLE
WHEN regexp_matches(t, '^[0-9]+:[0-9]+:[0-9.]+$') AND split_part(t, ':', 2)::DOUBLE < 60 AND split_part(t, ':', 3)::DOUBLE < 60 THEN split_part(t, ':', 1)::DOUBLE * 3600 + split_part(t, ':', 2)::DOUBLE * 60 + split_part(t, ':', 3)::DOUBLE END)"""
_MINUTES = "(CASE WHEN regexp_full_match(lower(t), '[0-9]+(\\.[0-9]+)?(分钟|分|min|m)?') THEN regexp_extract(t, '^[0-9.]+')::DOUBLE * 60 END)"
_MS = "CAST(floor({} * 1000::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


@query(rf"""WITH l AS (SELECT o_custkey, o_orderkey, trim({_line_sql(DURATION_LINES)}) AS line FROM orders), k AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no, line FROM l WHERE line <> ''),
p AS (SELECT *, replace(regexp_extract(line, '(?i)^(.*?)([0-9]+(:[0-9]{{1,2}}){{1,2}}(\.[0-9]+)?|[0-9]+(\.[0-9]+)?\s*(分钟|分|min|m)?)\s*$', 2), ' ', '') AS t, trim(regexp_replace(regexp_extract(line, '(?i)^(.*?)([0-9]+(:[0-9]{{1,2}}){{1,2}}(\.[0-9]+)?|[0-9]+(\.[0-9]+)?\s*(分钟|分|min|m)?)\s*$', 1), '[=:：,-]+$', '')) AS label FROM k),
m AS (SELECT *, {_MS.format(f"coalesce({_CLOCK}, {_MINUTES})")} AS ms FROM p)
SELECT o_custkey, line_no::INTEGER AS line, CASE WHEN ms > 0 THEN coalesce(TRY_CAST(regexp_extract(label, 'S([0-9]+)E', 1) AS INTEGER), TRY_CAST(regexp_extract(label, '第([0-9]+)季', 1) AS INTEGER)) END AS season_number,
CASE WHEN ms > 0 THEN coalesce(TRY_CAST(regexp_extract(label, 'S[0-9]+E([0-9]+)', 1) AS INTEGER), TRY_CAST(regexp_extract(label, '季第([0-9]+)集', 1) AS INTEGER), TRY_CAST(regexp_extract(label, '([0-9]{{1,3}})(?:集|話)?$', 1) AS INTEGER), line_no::INTEGER) END AS episode_number, CASE WHEN ms > 0 THEN ms END AS duration_ms FROM m""")
def rule_durations(spark, d):
    found = _texts(spark, d, DURATION_LINES).select("o_custkey", F.inline(rules.durations(F.col("text"))))
    return found.drop("text")


@query(rf"""WITH l AS (SELECT o_custkey, unnest(regexp_split_to_array({_line_sql(CUT_LINES)}, '[,，;；]+')) AS x FROM orders), k AS (SELECT o_custkey, replace(trim(x), ' ', '') AS t FROM l WHERE trim(x) <> ''),
m AS (SELECT *, {_MS.format(f"coalesce({_CLOCK}, {_MINUTES})")} AS ms FROM k)
SELECT o_custkey, coalesce(array_to_string(list(ms ORDER BY ms) FILTER (WHERE ms IS NOT NULL), ' '), '') AS cuts, count(*) FILTER (WHERE ms IS NULL) AS faults FROM m RIGHT JOIN (SELECT DISTINCT o_custkey FROM orders) USING (o_custkey) GROUP BY 1""".replace("count(*) FILTER (WHERE ms IS NULL)", "count(t) FILTER (WHERE ms IS NULL)"))
def rule_cut_points(spark, d):
    texts = _texts(spark, d, CUT_LINES)
    return texts.select("o_custkey", F.array_join(comments.parse_cut_points(F.col("text")).cast("array<string>"), " ").alias("cuts"), F.size(comments.cut_point_faults(F.col("text"))).cast("long").alias("faults"))


_ANCHORS = rf"""(WITH l AS (SELECT o_custkey, o_orderkey, trim({_line_sql(ANCHOR_LINES)}) AS line FROM orders), k AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no, list_filter(regexp_split_to_array(line, '\s*(->|=>|→|,|，|\t)\s*'), lambda x: x <> '') AS s FROM l WHERE line <> '' AND NOT starts_with(line, '#')),
q AS (SELECT *, (SELECT {_MS.format(_CLOCK)} FROM (SELECT s[1] AS t)) AS a, (SELECT {_MS.format(_CLOCK)} FROM (SELECT s[2] AS t)) AS b FROM k)
SELECT o_custkey, line_no::INTEGER AS line, CASE WHEN len(s) <> 2 THEN 'parts' WHEN a IS NULL OR b IS NULL THEN 'time' END AS fault, CASE WHEN len(s) = 2 AND b IS NOT NULL THEN a END AS source_ms, CASE WHEN len(s) = 2 AND a IS NOT NULL THEN b END AS target_ms FROM q)"""


@query(f"SELECT * FROM {_ANCHORS}")
def rule_anchors(spark, d):
    return _texts(spark, d, ANCHOR_LINES).select("o_custkey", F.inline(rules.anchors(F.col("text")))).drop("text")


@query(f"""WITH a AS (SELECT *, 'manual-anchor-' || line AS id FROM {_ANCHORS} WHERE fault IS NULL), s AS (SELECT *, target_ms - source_ms - lag(target_ms - source_ms) OVER (PARTITION BY o_custkey ORDER BY source_ms, target_ms, id) AS gap FROM a)
SELECT o_custkey, source_ms AS at_ms, gap AS gap_ms FROM s WHERE gap >= 1000""")
def anchor_offset_cuts(spark, d):
    found = _texts(spark, d, ANCHOR_LINES).select("o_custkey", F.inline(comments.parse_anchors(F.col("text"))))
    return merging.cuts_from_anchors(found, ["o_custkey"], "source_ms", "target_ms", "id", 1000).select("o_custkey", "at_ms", "gap_ms")


@query(f"""WITH x AS (SELECT o_orderkey, trim({_line_sql(_NUMBERS)}) AS t FROM orders)
SELECT o_orderkey, CAST(CASE WHEN regexp_full_match(t, '0x[0-9]+') THEN list_sum(list_transform(range(3, len(t) + 1), lambda i: t[i]::BIGINT * (16 ** (len(t) - i))::BIGINT)) WHEN regexp_full_match(t, '0b[01]+') THEN list_sum(list_transform(range(3, len(t) + 1), lambda i: t[i]::BIGINT * (2 ** (len(t) - i))::BIGINT))
WHEN regexp_full_match(t, '[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[0-9]+)?') THEN trunc(replace(t, '+', '')::DOUBLE) END AS BIGINT) AS whole FROM x""")
def rule_numbers(spark, d):
    return table(spark, d, "orders").select("o_orderkey", rules.whole_number(_line(_NUMBERS)).alias("whole"))


@query(f"""WITH o AS (SELECT user_id, t_ms, t_ms + event_id % 7 * 400 AS to_ms, event_id FROM {B.E_SQL}), s AS (SELECT *, to_ms - t_ms - lag(to_ms - t_ms) OVER (PARTITION BY user_id ORDER BY t_ms, to_ms, event_id) AS gap FROM o)
SELECT user_id, t_ms AS at_ms, gap AS gap_ms FROM s WHERE gap >= 1000""")
def event_offset_cuts(spark, d):
    pairs = B.events(spark, d).withColumn("to_ms", F.col("t_ms") + F.col("event_id") % 7 * 400)
    return merging.cuts_from_anchors(pairs, ["user_id"], "t_ms", "to_ms", "event_id", 1000).select("user_id", "at_ms", "gap_ms")

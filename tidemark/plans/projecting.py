"""The flagship in full: events of users as items of assets, through segments and maps made for every user."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import projection
from tidemark.plans import bindings as B
from tidemark.plans.collect import collector
from tidemark.session import cut, table

QUERIES, SQL, query = collector()

D = B.DAY
#: Spans of a user's first map in days, by source and target; the second map is one span.
_FIRST = [("matched", 0, 4, 0, 5), ("sourceOnly", 4, 5, 5, 5), ("targetOnly", 5, 5, 5, 6), ("matched", 5, 9, 6, 10), ("ambiguous", 9, 10, 10, 11)]


def _tables(spark, d):
    """Everything but the items, for every user that has events."""
    users = cut(table(spark, d, "events").select(F.col("user_id").alias("u")).distinct())
    days = lambda n: F.lit(n * D).cast("long")
    start = F.when(F.col("u") % 5 == 0, F.lit(int(9.5 * D))).otherwise(days(10)).cast("long")
    names = ("k", "kind", "source_start", "source_end", "target_start")
    three = [(F.lit(0), F.lit("content"), days(0), days(10), days(0)), (F.lit(1), F.lit("ignored"), start, days(12), F.lit(None).cast("long")), (F.lit(2), F.lit("content"), days(12), days(20), days(11))]
    rows = users.select("u", F.explode(F.array(*[F.struct(*[x.alias(n) for n, x in zip(names, xs, strict=True)]) for xs in three])).alias("s"))
    segments = rows.select((F.col("u") * 10 + F.col("s.k")).alias("segment_id"), "s.kind", F.col("u").alias("asset_id"), (F.col("u") * 2).alias("source_media"), F.when(F.col("s.kind") == "content", F.col("u") % 11 * 2 + 1).alias("target_media"), F.when(F.col("s.kind") == "content", F.col("u") * 10 + F.col("s.k")).alias("map_id"), "s.source_start", "s.source_end", "s.target_start")
    long = F.col("u") % 7 * 1000
    spans = users.select("u", F.posexplode(F.array(*[F.struct(F.lit(k).alias("kind"), *[days(x).alias(n) for n, x in zip(("source_start", "source_end", "target_start", "target_end"), xs, strict=True)]) for k, *xs in _FIRST])).alias("span_index", "s")).select((F.col("u") * 10).alias("map_id"), "span_index", "s.*", F.when((F.col("s.kind") == "ambiguous") & (F.col("u") % 3 == 0), "replacement").alias("decision"))
    second = users.select((F.col("u") * 10 + 2).alias("map_id"), F.lit(0).alias("span_index"), F.lit("matched").alias("kind"), days(12).alias("source_start"), days(20).alias("source_end"), days(11).alias("target_start"), (days(18) + long).alias("target_end"), F.lit(None).cast("string").alias("decision"))
    spans = spans.unionByName(second).withColumn("level", F.lit("verified"))
    maps = segments.filter("kind = 'content'").select("map_id", F.when((F.col("map_id") % 10 == 2) & (F.col("asset_id") % 7 == 0), "draft").otherwise("confirmed").alias("state"), "source_media", "target_media", "source_start", "source_end", "target_start", F.when(F.col("map_id") % 10 == 0, days(11)).otherwise(days(18) + F.col("asset_id") % 7 * 1000).alias("target_end"), F.lit("verified").alias("level"), (F.col("asset_id") % 13 != 1).alias("identity_ok"))
    bindings = users.filter("u % 17 <> 3").select(F.col("u").alias("asset_id"), (F.col("u") * 2).alias("source_media"))
    sources = users.select((F.col("u") * 2).alias("media_id"), F.lit(projection.SOURCE_ROLE).alias("role"), F.lit(None).cast("long").alias("duration_ms"))
    targets = users.select((F.col("u") % 11 * 2 + 1).alias("t")).distinct().select((-F.col("t")).alias("media_id"), F.lit(projection.TARGET_ROLE).alias("role"), days(17).alias("duration_ms"))
    segments = segments.withColumn("target_media", -F.col("target_media"))
    maps = maps.withColumn("target_media", -F.col("target_media"))
    items = B.events(spark, d).select(F.col("user_id").alias("asset_id"), (F.col("event_id") % 5000).alias("item_id"), F.col("event_id").alias("original_index"), F.col("t_ms").alias("at_ms"), (F.col("event_type") != "error").alias("enabled"))
    disabled = table(spark, d, "events").filter("event_id % 97 = 0").select((F.col("event_id") % 5000).alias("item_id")).distinct()
    adjustments = table(spark, d, "events").filter("event_id % 89 = 0").groupBy((F.col("event_id") % 5000).alias("item_id")).agg(F.lit(-250).cast("long").alias("adjustment_ms"))
    assets = users.select(F.col("u").alias("asset_id"))
    return segments, cut(projection.segment_blockers(segments, assets, maps, spans, bindings, sources.unionByName(targets))), items, spans, disabled, adjustments, targets


_U = "u AS (SELECT DISTINCT user_id AS u FROM events)"
_BLOCKERS = f"""{_U}, b AS (SELECT u, k, CASE WHEN u % 5 = 0 AND k < 2 THEN 'overlap' WHEN u % 17 = 3 THEN 'notBound' WHEN k = 1 THEN NULL WHEN k = 2 AND u % 7 = 0 THEN 'unconfirmed' WHEN k = 0 AND u % 3 <> 0 THEN 'ambiguous' WHEN u % 13 = 1 THEN 'identity' END AS blocker FROM u, range(3) r(k))"""
_ITEMS = f"""i AS (SELECT user_id AS u, event_id, event_id % 5000 AS item_id, t_ms AS t, event_type <> 'error' AND event_id % 5000 NOT IN (SELECT event_id % 5000 FROM events WHERE event_id % 97 = 0) AS enabled, CASE WHEN event_id % 5000 IN (SELECT event_id % 5000 FROM events WHERE event_id % 89 = 0) THEN -250 ELSE 0 END AS moved FROM {B.E_SQL}),
m AS (SELECT i.*, k, blocker, CASE WHEN k = 0 AND t < {10 * D} THEN CASE WHEN t < {4 * D} THEN 'mapped' WHEN t < {5 * D} THEN 'sourceOnly' WHEN t < {9 * D} THEN 'mapped' ELSE 'sourceOnly' END WHEN k = 1 AND t >= {10 * D} AND t < {12 * D} THEN 'ignored' WHEN k = 2 AND t >= {12 * D} AND t < {20 * D} THEN 'mapped' END AS what,
    CASE WHEN k = 2 THEN least({18 * D} + u % 7 * 1000 - 1, {11 * D} + (2 * (t - {12 * D})::HUGEINT * ({7 * D} + u % 7 * 1000) + {8 * D}) // {16 * D}) WHEN t < {4 * D} THEN least({5 * D - 1}, (2 * t::HUGEINT * {5 * D} + {4 * D}) // {8 * D}) ELSE t + {D} END + moved AS final_ms FROM i JOIN b USING (u))"""


@query(f"WITH {_BLOCKERS} SELECT u * 10 + k AS segment_id, CASE WHEN k = 1 THEN 'ignored' ELSE 'content' END AS kind, blocker FROM b")
def projection_blockers(spark, d):
    return _tables(spark, d)[1]


@query(f"""WITH {_BLOCKERS}, {_ITEMS}, o AS (SELECT u, item_id, max(CASE WHEN blocker IS NOT NULL OR what IS NULL THEN 0 WHEN what = 'mapped' THEN 3 WHEN what = 'sourceOnly' THEN 2 ELSE 1 END) AS r FROM m GROUP BY ALL)
SELECT CASE r WHEN 3 THEN 'mapped' WHEN 2 THEN 'sourceOnly' WHEN 1 THEN 'ignored' ELSE 'unexpected' END AS outcome, count(*) AS n FROM o GROUP BY 1""")
def projection_outcomes(spark, d):
    """Items by what becomes of them."""
    segments, blockers, items, spans, disabled, adjustments, _ = _tables(spark, d)
    return projection.project_items(segments, blockers, items, spans, disabled, adjustments).outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_BLOCKERS}, {_ITEMS} SELECT -(u % 11 * 2 + 1) AS target_media, count(*) FILTER (WHERE enabled) AS entries, count(*) FILTER (WHERE NOT enabled) AS disabled, count(*) FILTER (WHERE enabled AND final_ms < 0) AS negative, count(*) FILTER (WHERE enabled AND final_ms >= {17 * D}) AS overflow,
CAST(min(final_ms) FILTER (WHERE enabled) AS BIGINT) AS first_ms, CAST(max(final_ms) FILTER (WHERE enabled) AS BIGINT) AS last_ms FROM m WHERE blocker IS NULL AND what = 'mapped' GROUP BY 1""")
def projection_targets(spark, d):
    """What each target gets."""
    segments, blockers, items, spans, disabled, adjustments, media = _tables(spark, d)
    return projection.target_groups(projection.project_items(segments, blockers, items, spans, disabled, adjustments).entries, media)


@query(f"""WITH {_BLOCKERS}, {_ITEMS} SELECT -(u % 11 * 2 + 1) AS target_media, u AS asset_id, event_id AS original_index, final_ms::BIGINT AS final_ms, row_number() OVER (PARTITION BY u % 11 ORDER BY final_ms, event_id) AS place FROM m WHERE blocker IS NULL AND what = 'mapped' AND enabled""")
def projection_entries(spark, d):
    """Every target's entries in their order."""
    segments, blockers, items, spans, disabled, adjustments, _ = _tables(spark, d)
    found = projection.project_items(segments, blockers, items, spans, disabled, adjustments)
    return projection.in_order(found.entries).select("target_media", "asset_id", "original_index", "final_ms", "place")

"""Named inputs of the queries, from the tables and from short inline lists; the same ones as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.timemap import SPAN_SCHEMA
from tidemark.session import table

EPOCH = 1704067200000  # 2024-01-01T00:00:00Z
DAY = 86_400_000

SPANS = [
    ("click", 0, "matched", 0, 30 * DAY, 0, 30 * DAY), ("click", 1, "targetOnly", 30 * DAY, 30 * DAY, 30 * DAY, 31 * DAY), ("click", 2, "matched", 30 * DAY, 90 * DAY, 31 * DAY, 106 * DAY),
    ("view", 0, "matched", 0, 10 * DAY, 0, 12 * DAY), ("view", 1, "sourceOnly", 10 * DAY, 20 * DAY, 12 * DAY, 12 * DAY), ("view", 2, "ambiguous", 20 * DAY, 25 * DAY, 12 * DAY, 17 * DAY), ("view", 3, "matched", 25 * DAY, 400 * DAY, 17 * DAY, 380 * DAY + 7),
    ("purchase", 0, "matched", 5 * DAY, 200 * DAY, 0, 195 * DAY), ("signup", 0, "ambiguous", 0, 100 * DAY, 0, 100 * DAY), ("signup", 1, "matched", 100 * DAY, 366 * DAY, 100 * DAY, 260 * DAY),
]
BAD_SPANS = [
    ("m", 0, "matched", 0, 1000, 0, 1000), ("m", 1, "matched", 1100, 2000, 1000, 900), ("m", 2, "sourceOnly", 1900, 2400, 900, 950), ("m", 3, "targetOnly", 2400, 2400, 1000, 1500),
    ("n", 0, "matched", 0, 0, 0, 500), ("n", 1, "wrong", 0, 700, 500, 900), ("n", 2, "ambiguous", 700, 700, 900, 900), ("n", 3, "matched", 700, 900, 900, 1200),
    ("p", 0, "matched", -5, 100, 0, 100), ("p", 1, "matched", 100, 300, 100, 300), ("p", 2, "matched", 50, 400, 300, 500), ("p", 3, "sourceOnly", 400, 500, 400, 400), ("p", 4, "matched", 600, 700, 450, 600),
]
MARKERS = [("c1", 5 * DAY, 1000), ("c2", 20 * DAY, 2500), ("c3", 20 * DAY, 400), ("c4", 60 * DAY, 90000)]
CLIPS = [("k1", "click", 1000, 0, 40 * DAY, 0, True), ("k2", "click", 500000, 20 * DAY, 50 * DAY, -700, True), ("k3", "view", 0, 5 * DAY, 15 * DAY, 250, True), ("k4", "purchase", 0, 0, 90 * DAY, 0, False)]


def _values(rows: list[tuple], names: str) -> str:
    def lit(v: object) -> str:
        return f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else f"CAST({v} AS BIGINT)"

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names}))"


E_SQL = f"(SELECT event_id, event_type, user_id, value, CAST(epoch_us(ts) // 1000 AS BIGINT) - {EPOCH} AS t_ms FROM events)"
SPANS_SQL = _values(SPANS, "map_id, span_index, kind, s0, s1, t0, t1")
BAD_SPANS_SQL = _values(BAD_SPANS, "map_id, span_index, kind, s0, s1, t0, t1")
MARKERS_SQL = _values(MARKERS, "marker, at_ms, gap_ms")
CLIPS_SQL = _values(CLIPS, "clip_id, asset_id, line_start, in_ms, out_ms, local_ms, enabled")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_millis(F.col("ts").cast("timestamp")) - F.lit(EPOCH)
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value", t.alias("t_ms"))


def spans(spark: SparkSession, rows: list[tuple] = SPANS) -> DataFrame:
    return spark.createDataFrame(rows, SPAN_SCHEMA)


def markers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MARKERS, "marker string, at_ms bigint, gap_ms bigint")


def clips(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLIPS, "clip_id string, asset_id string, line_start bigint, in_ms bigint, out_ms bigint, local_ms bigint, enabled boolean")

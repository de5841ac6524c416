"""Queries over signals put together from embeddings: a label's vectors are the chunks of its signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import affine, folds, offsets, spectrum, visual
from tidemark.operators.ordering import numbered
from tidemark.plans import bindings as B
from tidemark.plans.collect import collector
from tidemark.session import cut, table

QUERIES, SQL, query = collector()

SOUND = spectrum.Sound(rate=1000, silence=0.001, above_mean=1.6, per_family=8)
#: Full scale of a vector's numbers.
LOUD = 20_000


def _chunks(spark, d):
    rows = table(spark, d, "embeddings").filter("embedding IS NOT NULL AND label IS NOT NULL")
    return rows.select("label", F.col("vec_id").alias("seq"), F.transform("embedding", lambda x: F.floor(x.cast("double") * LOUD).cast("int")).alias("samples"))


def _landmarks(spark, d):
    peaked = spectrum.peaks(spectrum.spectral_frames(spectrum.frames(_chunks(spark, d), "label", SOUND), "label", SOUND), "label", SOUND)
    return spectrum.numbered_landmarks(spectrum.landmarks(peaked, "label", SOUND), "label")


_BINS = SOUND.bins()
_LANDMARKS = f"""x AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS k, v FROM (SELECT label, vec_id, unnest(range(len(embedding))) AS i, floor(unnest(embedding)::DOUBLE * {LOUD}) AS v FROM embeddings)),
n AS (SELECT label, (count(*) - {SOUND.window}) // {SOUND.hop} + 1 AS n FROM x GROUP BY 1 HAVING count(*) >= {SOUND.window}),
f AS (SELECT label, f, k - f * {SOUND.hop} AS j, v / 32767 AS v FROM (SELECT label, k, v, n, unnest(range(greatest(0, (k - {SOUND.window}) // {SOUND.hop}), k // {SOUND.hop} + 1)) AS f FROM x JOIN n USING (label)) WHERE f < n AND k - f * {SOUND.hop} BETWEEN 0 AND {SOUND.window - 1}),
w AS (SELECT *, v * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / {SOUND.window - 1})) AS h FROM f), u AS (SELECT DISTINCT unnest({_BINS}) AS bin),
s AS (SELECT label, f, bin, sqrt(sum(h * cos(2 * pi() * bin * j / {SOUND.length})) ** 2 + sum(h * sin(2 * pi() * bin * j / {SOUND.length})) ** 2) AS m, sqrt(avg(v * v)) AS loud FROM w, u GROUP BY ALL),
b AS (SELECT label, f, band - 1 AS band, m, loud FROM s JOIN (SELECT unnest({_BINS}) AS bin, unnest(range(1, 49)) AS band) USING (bin)),
p AS (SELECT *, lag(m) OVER (PARTITION BY label, f ORDER BY band) AS low, lead(m) OVER (PARTITION BY label, f ORDER BY band) AS high, coalesce(lag(m) OVER (PARTITION BY label, band ORDER BY f), 0) AS before, coalesce(lead(m) OVER (PARTITION BY label, band ORDER BY f), 0) AS behind, avg(m) OVER (PARTITION BY label, f) AS mean FROM b),
q AS (SELECT label, f, band, m, row_number() OVER (PARTITION BY label, f ORDER BY m DESC, band) AS r FROM p WHERE band BETWEEN 1 AND 46 AND m > low AND m >= high AND m >= before AND m > behind AND m >= mean * {SOUND.above_mean} AND loud >= {SOUND.silence} QUALIFY r <= {SOUND.peaks}),
t AS (SELECT *, (f * {SOUND.hop} + {SOUND.window // 2}) AS t FROM q),
l AS (SELECT a.label, a.t AS time_ms, (a.band << 16) | (c.band << 8) | least(255, (c.t - a.t + 25) // 50) AS hash, CAST(floor(ln(least(a.m, c.m) + 1) * 1000 + 0.5) AS BIGINT) AS strength, row_number() OVER (PARTITION BY a.label, a.f, a.r ORDER BY c.f, c.r) AS j, c.f AS until, a.f AS f, a.r AS r, c.r AS cr FROM t a JOIN t c ON a.label = c.label AND c.t - a.t BETWEEN {SOUND.least_ms} AND {SOUND.most_ms} QUALIFY j <= {SOUND.partners}),
o AS (SELECT *, hash >> 8 AS family, row_number() OVER (PARTITION BY label, hash >> 8 ORDER BY until, f, r, j) - 1 AS ordinal FROM l)"""


@query(f"WITH {_LANDMARKS} SELECT label, time_ms::BIGINT AS time_ms, hash::BIGINT AS hash, strength, family::BIGINT AS family, ordinal FROM o")
def spectral_landmarks(spark, d):
    return _landmarks(spark, d)


@query(f"WITH {_LANDMARKS} SELECT label, family::BIGINT AS family, least(count(*), {SOUND.per_family}) AS kept, count(*) AS seen FROM o GROUP BY ALL")
def landmark_families(spark, d):
    """How many landmarks of every family the bounded index keeps, and how many there were."""
    rows = cut(_landmarks(spark, d))
    kept = spectrum.bounded_index(rows, "label", SOUND).groupBy("label", "family").agg(F.count(F.lit(1)).alias("kept"))
    return kept.join(rows.groupBy("label", "family").agg(F.count(F.lit(1)).alias("seen")), ["label", "family"])


@query(f"""WITH {_LANDMARKS}, i AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY time_ms, hash, strength DESC) - 1 AS i, row_number() OVER (PARTITION BY label, family ORDER BY time_ms, hash, strength DESC) - 1 AS n, count(*) OVER (PARTITION BY label, family) AS size, count(*) OVER (PARTITION BY label) AS total FROM o)
SELECT a.label * 1000 + b.label AS pair_id, a.time_ms::BIGINT AS source_ms, b.time_ms::BIGINT AS target_ms FROM i a JOIN i b ON a.family = b.family AND a.label < b.label AND abs((a.hash & 255) - (b.hash & 255)) <= 1 WHERE a.size <= 64 AND b.size <= 64 AND b.n % ceil(b.size / 8.0::DOUBLE)::BIGINT = 0 AND a.i % ceil(a.total / 5000.0::DOUBLE)::BIGINT = 0""")
def landmark_observations(spark, d):
    """Where every two labels have a landmark in common, families that are too common left out."""
    rows = cut(_landmarks(spark, d))
    labels = rows.select("label").distinct()
    pairs = labels.join(labels.withColumnRenamed("label", "target"), F.col("label") < F.col("target")).select((F.col("label") * 1000 + F.col("target")).alias("pair_id"), F.col("label").alias("source"), "target")
    return spectrum.observations(pairs, rows, "label").select(F.col("pair_id").cast("int"), "source_ms", "target_ms")


@query()
def landmark_lines(spark, d):
    """The best lines between every two labels' clocks."""
    rows = cut(_landmarks(spark, d))
    labels = rows.select("label").distinct()
    pairs = labels.join(labels.withColumnRenamed("label", "target"), F.col("label") < F.col("target")).select((F.col("label") * 1000 + F.col("target")).alias("pair_id"), F.col("label").alias("source"), "target")
    return affine.affine_lines(spectrum.observations(pairs, rows, "label")).select("pair_id", "rank", "scale", "offset_ms", "inliers", "fault")


_PIXELS = "least(255, greatest(0, floor(128 + embedding[(x + 2 * y) % 64 + 1]::DOUBLE * 300 + embedding[(3 * x + y) % 64 + 1]::DOUBLE * 200)))::INTEGER"


def _pictures(spark, d):
    rows = table(spark, d, "embeddings").filter("embedding IS NOT NULL AND label IS NOT NULL")

    def pixel(k):
        x, y = k % visual.SIDE, F.floor(k / visual.SIDE)
        a, b = (F.get("embedding", (i % 64).cast("int")).cast("double") for i in (x + 2 * y, 3 * x + y))
        return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.lit(128) + a * 300 + b * 200))).cast("int")

    return rows.select("label", "vec_id", F.transform(F.sequence(F.lit(0), F.lit(visual.SIDE**2 - 1)), pixel).alias("pixels"))


@query(f"""WITH p AS (SELECT vec_id, x, y, {_PIXELS} AS v FROM embeddings, range(32) a(x), range(32) b(y)), c AS (SELECT u, x, cos((2 * x + 1) * u * pi() / 64) AS c FROM range(8) a(u), range(32) b(x)),
r AS (SELECT vec_id, y, u, sum(v * c) AS s FROM p JOIN c USING (x) GROUP BY ALL), k AS (SELECT vec_id, c.u * 8 + r.u AS i, sum(s * c.c) AS s FROM r JOIN c ON c.x = r.y GROUP BY ALL),
m AS (SELECT vec_id, list_sort(list(s) FILTER (WHERE i > 0))[32] AS middle FROM k GROUP BY 1), h AS (SELECT vec_id, bit_or(CASE WHEN i > 0 AND s > middle THEN 1::UBIGINT << i::UBIGINT ELSE 0::UBIGINT END) AS h FROM k JOIN m USING (vec_id) GROUP BY 1)
SELECT vec_id, CASE WHEN var_pop(v) >= 36 THEN (any_value(h)::HUGEINT - CASE WHEN any_value(h) >= 9223372036854775808 THEN 18446744073709551616::HUGEINT ELSE 0 END)::BIGINT END AS hash FROM p JOIN h USING (vec_id) GROUP BY vec_id""")
def dct_hashes(spark, d):
    return _pictures(spark, d).select("vec_id", visual.dct_hash(F.col("pixels")).alias("hash"))


@query()
def frame_runs(spark, d):
    """Runs of pictures of a label that come again 20 steps later with little changed."""
    # Pictures are hashed where they are read, and once: ranges are drawn from a table of its own.
    hashes = cut(_pictures(spark, d).select("label", "vec_id", visual.dct_hash(F.col("pixels")).alias("hash")))
    frames = cut(numbered(hashes, ["label"], "vec_id", pos="p").select("label", ((F.col("p") + 1) * visual.STEP_MS).cast("long").alias("at_ms"), "hash"))
    changed = F.col("hash").bitwiseXOR(F.call_function("shiftleft", F.lit(5).cast("bigint"), (F.col("at_ms") / visual.STEP_MS % 61).cast("int")))
    later = frames.select("label", (F.col("at_ms") + 20 * visual.STEP_MS).alias("at_ms"), changed.alias("hash"))
    matches = visual.frame_matches(frames, later, ["label"]).filter("NOT ambiguous")
    return visual.steady_runs(matches, ["label"]).select("label", "source_start", "source_end", "target_start", "target_end", "anchors")


_CUTS = f"(SELECT user_id, t_ms // 40000 AS at_ms, 1000 + event_id % 5 * 500 AS gap, value AS confidence, t_ms // 40000 - event_id % 300 AS a, t_ms // 40000 + event_id % 200 AS b FROM {B.E_SQL})"


@query(f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_ms, gap, confidence, a, b) AS i FROM {_CUTS}),
s AS (SELECT user_id, i, at_ms, gap, confidence, a, b, at_ms AS head FROM c WHERE i = 1 UNION ALL SELECT c.user_id, c.i, c.at_ms, c.gap, c.confidence, c.a, c.b, CASE WHEN abs(c.at_ms - s.head) <= 2000 THEN s.head ELSE c.at_ms END FROM s JOIN c ON c.user_id = s.user_id AND c.i = s.i + 1),
g AS (SELECT *, sum(CASE WHEN head = at_ms AND (i = 1 OR head <> before) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS n FROM (SELECT *, lag(head) OVER (PARTITION BY user_id ORDER BY i) AS before FROM s))
SELECT user_id, head AS at_ms, CAST(sum(gap) AS BIGINT) AS gap, min(confidence) AS confidence, min(a) AS range_start, max(b) AS range_end, count(*) AS merged FROM g GROUP BY user_id, n, head""")
def merged_cuts(spark, d):
    e = B.events(spark, d)
    at_ms = F.floor(F.col("t_ms") / 40000)
    cuts = e.select("user_id", at_ms.alias("at_ms"), (1000 + F.col("event_id") % 5 * 500).alias("gap"), F.col("value").alias("confidence"), (at_ms - F.col("event_id") % 300).alias("a"), (at_ms + F.col("event_id") % 200).alias("b"))
    return folds.merge_near(cuts, ["user_id"], "at_ms", "gap", "confidence", "a", "b")


_OFFSETS = f"(SELECT user_id, t_ms AS at_ms, t_ms // 300000000 * 1500 + CASE WHEN event_id % 9 = 0 THEN 7000 ELSE event_id % 3 * 30 END AS o FROM {B.E_SQL})"


@query(f"""WITH RECURSIVE r AS (SELECT user_id, at_ms, o, CAST(floor(o / 100.0::DOUBLE + 0.5) * 100 AS BIGINT) AS x, row_number() OVER (PARTITION BY user_id ORDER BY at_ms, o) AS i FROM {_OFFSETS}),
w AS (SELECT *, list(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS ahead FROM r), t AS (SELECT *, len(list_filter(ahead, lambda y: abs(y - x) <= 100)) >= greatest(least(5, len(ahead)), ceil(len(ahead) * 0.7::DOUBLE)) AS stable FROM w),
s AS (SELECT user_id, i, at_ms, o, x AS held FROM t WHERE i = 1 UNION ALL SELECT t.user_id, t.i, t.at_ms, t.o, CASE WHEN t.x - s.held >= 1000 AND t.stable THEN t.x ELSE s.held END FROM s JOIN t ON t.user_id = s.user_id AND t.i = s.i + 1)
SELECT user_id, at_ms, o, held FROM s""")
def held_offsets(spark, d):
    e = B.events(spark, d)
    offset = F.floor(F.col("t_ms") / 300_000_000) * 1500 + F.when(F.col("event_id") % 9 == 0, F.lit(7000)).otherwise(F.col("event_id") % 3 * 30)
    return folds.held_offsets(e.select("user_id", F.col("t_ms").alias("at_ms"), offset.cast("long").alias("o")), ["user_id"], "at_ms", "o", 1000, 100)


def _shifted(spark, d):
    """A label's vectors as a source, and all but its first seven, a little shortened, as the target."""
    rows = numbered(table(spark, d, "embeddings").filter("embedding IS NOT NULL AND label IS NOT NULL").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("values")), ["label"], "vec_id", pos="p")
    source = rows.select(F.col("label").alias("pair_id"), F.lit("source").alias("side"), (F.col("p") * 500).alias("at_ms"), "values")
    target = rows.filter("p >= 7").select(F.col("label").alias("pair_id"), F.lit("target").alias("side"), ((F.col("p") - 7) * 500).alias("at_ms"), F.transform("values", lambda x: x * 0.9).alias("values"))
    return source.union(target)


@query("""WITH f AS (SELECT label AS pair_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT pair_id, count(*) AS n FROM f GROUP BY 1),
d AS (SELECT a.pair_id, a.p AS i, b.p - 7 - a.p AS k, sqrt(list_avg(list_transform(range(1, len(a.v) + 1), lambda j: (a.v[j] - b.v[j] * 0.9::DOUBLE) ** 2))) AS d FROM f a JOIN f b ON a.pair_id = b.pair_id AND b.p >= 7),
c AS (SELECT pair_id, n, unnest(range(12, n - 12, 6)) AS c FROM n), s AS (SELECT c.pair_id, c, k, avg(d) AS d FROM c JOIN d ON c.pair_id = d.pair_id AND d.i >= c - 12 AND d.i < c + 12 WHERE k * 500 BETWEEN -63500 AND 60000 GROUP BY ALL HAVING count(*) = 24)
SELECT pair_id, c AS source_index, CAST(arg_min(k, (round(d, 9), k)) * 500 AS BIGINT) AS offset_ms, round(min(d), 6) AS distance FROM s GROUP BY ALL""")
def block_offsets(spark, d):
    """Where every block of a label's frames lies best in the shifted ones."""
    return offsets.offset_observations(_shifted(spark, d), pieces=True).select("pair_id", "source_index", "offset_ms", F.round("distance", 6).alias("distance"))


@query()
def agreed_offsets(spark, d):
    """The offset that most blocks of a label agree on; labels of few frames have too few blocks."""
    found = offsets.offset_observations(_shifted(spark, d), pieces=True)
    ends = found.groupBy("pair_id").agg(F.min(F.col("source_ms") + F.col("offset_ms")).alias("target_start"), F.max(F.col("source_ms") + F.col("offset_ms")).alias("target_end"))
    blocks = found.join(ends, "pair_id").select("pair_id", "source_ms", (F.col("source_ms") + F.col("offset_ms")).alias("target_ms"), (1 - F.col("distance")).alias("score"), F.lit(0.5).alias("margin"), F.lit(False).alias("held_out"), "target_start", "target_end")
    rules = offsets.PlaceRules(tolerance_ms=1000, stride_ms=3000, least=3)
    return offsets.located_offsets(blocks, rules=rules).filter("rank = 1").select("pair_id", "offset_ms")

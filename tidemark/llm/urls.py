"""URL filtering with a Bloom filter cascade, in DataFrame functions only.

A cascade answers membership exactly for every key of a known universe: level 1 encodes the listed keys, level 2
the other keys of the universe that level 1 wrongly accepts, level 3 the listed keys that level 2 wrongly accepts,
and so on until a level has no false positive.  The universe is every key that the corpus can ask for, so the
filter needs no join at query time: a lookup is a few hash probes into literal arrays.

A list too long for one cascade is split by a hash of its keys, one cascade for each part.

Cases: a null URL or one without ``://`` has an empty host and path and meets no rule; an empty rule list allows
everything; repeated pages are judged each on its own; columns ``host``, ``path``, ``rule`` and ``verdict`` of the pages
are replaced, all others pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut, fresh, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bound on one level's bits, for which a list is split; literals of this size still travel with the plan.
MAX_LEVEL_BITS = 1 << 22


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


#: The rules of the production query (fixed values).
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


@dataclass
class BloomCascade:
    """Levels of (bits, probes, 64-bit words); odd levels hold listed keys, even ones the rest of the universe."""

    seed: int
    levels: list[tuple[int, int, list[int]]] = field(default_factory=list)
    #: The cascades of the keys' parts, where the list was split; ``levels`` is empty then.
    parts: list["BloomCascade"] = field(default_factory=list)

    def _in_level(self, key: Column, level: int) -> Column:
        bits, probes, words = self.levels[level]
        held = F.array(*[F.lit(w) for w in words])
        hit = F.lit(True)
        for position in _positions(key, self.seed + level, bits, probes):
            word = F.get(held, F.floor(position / 64).cast("int"))
            hit = hit & (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (position % 64).cast("int"))) != 0)
        return hit

    def contains(self, key: Column) -> Column:
        """Whether ``key``, one of the universe, is listed."""
        if self.parts:
            answer = F.lit(False)
            for k, part in enumerate(self.parts):
                answer = F.when(_part(key, len(self.parts)) == k, part.contains(key)).otherwise(answer)
            return answer
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            answer = F.when(self._in_level(key, level), answer).otherwise(F.lit(level % 2 == 1))
        return answer


def _positions(key: Column, seed: int, bits: int, probes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * 64 + i)), F.lit(bits).cast("bigint")) for i in range(probes)]


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))


def build_cascade(keys: DataFrame, seed: int = 1, first_rate: float | None = None) -> BloomCascade:
    """Cascade over ``keys`` (key, listed): one row per key of the universe.

    Level sizes follow the number of listed keys: the first level's error rate is chosen so that about as many
    other keys pass as there are listed ones, later levels use one half.  Only level words reach the driver.
    """
    cascade = BloomCascade(seed)
    counts = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
    listed, others = counts.get(True, 0), counts.get(False, 0)
    if not listed:
        return cascade
    rate = first_rate or min(0.5, max(1e-6, listed * math.sqrt(0.5) / max(1, others)))
    alive, inside, n = keys, True, listed
    while n:
        bits = max(64, 64 * math.ceil(1.44 * n * math.log2(1 / rate) / 64))
        if bits > MAX_LEVEL_BITS:
            parts = 2 * -(-bits // MAX_LEVEL_BITS)
            return BloomCascade(seed, parts=[build_cascade(keys.filter(_part(F.col("key"), parts) == k), seed + 1000 * (k + 1), rate) for k in range(parts)])
        probes = max(1, round(math.log2(1 / rate)))
        level = len(cascade.levels)
        position = F.explode(F.array(*_positions(F.col("key"), seed + level, bits, probes))).alias("p")
        rows = (
            alive.filter(F.col("listed") == inside)
            .select(position)
            .select(F.floor(F.col("p") / 64).cast("int").alias("w"), (F.col("p") % 64).cast("int").alias("b"))
            .groupBy("w")
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("b"))).alias("bits"))
            .collect()
        )
        words = [0] * (bits // 64)
        for r in rows:
            words[r["w"]] = r["bits"]
        cascade.levels.append((bits, probes, words))
        # Of the other side, only keys that this level wrongly accepts go on; this side's keys stay for the next level.
        alive = alive.filter((F.col("listed") == inside) | cascade._in_level(F.col("key"), level))
        inside, rate = not inside, 0.5
        n = alive.filter(F.col("listed") == inside).count()
    return cascade


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(url)), r"^([^?#]*)", 1)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The keys under which a rule can fit, longest first.

    Only suffixes with as many labels, and prefixes with as many characters, as some rule has are made, so a URL
    has a number of candidates that does not depend on its length.
    """
    labels = F.split(host, r"\.", -1)
    made = []
    for n in sorted({r.host.count(".") + 1 for r in rules}):
        for k in sorted({len(r.path) for r in rules}):
            fits = (F.size(labels) >= n) & (F.length(path) >= k)
            made.append(F.when(fits, F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring(path, 1, k))))
    if not made:
        return F.array().cast("array<string>")
    by_length = F.transform(F.array_compact(F.array(*made)), lambda c: F.struct((-F.length(c)).alias("n"), c.alias("key")))
    return F.transform(F.array_sort(by_length), lambda x: x["key"])


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict: the longest fitting rule's verdict, else ``default``."""
    host, path = split_url(F.col(url))
    keys, found = fresh(pages, "keys", "found")
    split = pages.withColumns({"host": host, "path": path})
    split = split.withColumn(keys, candidate_keys(F.col("host"), F.col("path"), rules))
    spark: SparkSession = pages.sparkSession
    universe = split.select(F.explode(keys).alias("key")).distinct()
    listed = spark.createDataFrame([(r.key, r.verdict) for r in rules] or [("", "")], "key string, verdict string")
    known = cut(universe.join(listed, "key", "left"))
    verdicts = sorted({r.verdict for r in rules})
    cascades = {v: build_cascade(known.select("key", F.coalesce(F.col("verdict") == v, F.lit(False)).alias("listed")), seed=1 + 97 * i) for i, v in enumerate(verdicts)}
    if not rules:
        return split.drop(keys).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    def judged(key: Column) -> Column:
        out = F.lit(None).cast("string")
        for v, cascade in cascades.items():
            out = F.when(cascade.contains(key), F.lit(v)).otherwise(out)
        return out

    each = F.transform(F.col(keys), lambda k: F.struct(k.alias("rule"), judged(k).alias("verdict")))
    first = F.get(F.filter(each, lambda x: x["verdict"].isNotNull()), F.lit(0))
    held = split.withColumn(found, first)
    return held.withColumns({"rule": F.col(found)["rule"], "verdict": F.coalesce(F.col(found)["verdict"], F.lit(default))}).drop(keys, found)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM h),
r AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
      CASE WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
           WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
           WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
           WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
           WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

"""Phrases whose words stand together more often than their parts would by chance.

Level by level: words are counted first; then phrases of k words are counted only where both phrases of k - 1 words
inside them are frequent, which every frequent phrase fulfils.  What tasks get of the frequent phrases is a bit per
hash, so it is bounded (FILTER_BITS): a bit that several phrases share lets a rare phrase be counted, and its count
drops it, so counts and results are exact whatever the size.  Counts are by the words themselves, never by hashes.
The scores of a phrase's cuts are read from the tables of the levels.

Cases: documents without text have no words; without lang they count as `und`; words of any length and texts of any
length are read whole; rows that repeat a document count again; an empty table has no phrases; further columns of the
documents, whatever their names, are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordering import numbered
from tidemark.session import cut, held, send, ship_package, table

LONGEST = 5
MINIMUM = 100
REPORTED = 2_000
#: Bits for each frequent phrase, and bits at most (32 MiB, from 16 million phrases on).
BITS_EACH, FILTER_BITS = 16, 1 << 28
#: Positions looked at together, bytes of text gathered and split together, words a task remembers.
POSITIONS, CHUNK, BLOCK, REMEMBERED = 1 << 20, 1 << 23, 1 << 20, 200_000

BREAKS = ".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(10 if chr(b) in BREAKS else 32 if b == 9 else b for b in range(256))
_SKIP, _BREAK = 0, 1


class Words:
    """Numbers of words, with the words' hashes; a number stands for a language and a word."""

    def __init__(self) -> None:
        self.names: list[bytes] = [b"", b"\n"]
        self.langs: list[str] = ["", ""]
        self.hashes: list[int] = [0, 0]
        self.by_lang: dict[str, _Lang] = {}

    def encode(self, lang: str, raw: bytes) -> np.ndarray:
        """Numbers of the words and breaks of ``raw``, which is split block by block."""
        own = self.by_lang.get(lang)
        if own is None:
            own = self.by_lang[lang] = _Lang(self, lang)
        out, start = [], 0
        while start < len(raw):
            end = start + BLOCK
            if end < len(raw):  # a block ends before a blank or a break
                ends = [e for e in (raw.find(b" ", end), raw.find(b"\n", end)) if e >= 0]
                end = min(ends, default=len(raw))
            block = pa.array([raw[start:end].replace(b"\n", b" \n ")], pa.binary())
            names = pc.split_pattern(block, b" ").flatten().dictionary_encode()
            known = np.fromiter(map(own.__getitem__, names.dictionary.to_pylist()), np.int32, len(names.dictionary))
            numbers = known[names.indices.to_numpy(zero_copy_only=False)]
            out.append(numbers[numbers != _SKIP])
            start = end
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def prepared(text: str) -> bytes:
    """``text`` with A-Z in lower case, every break a line feed and every blank a space."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_TABLE)


def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray, bool]]:
    """Numbers of whole documents of one language, CHUNK bytes or a longer document at a time, and whether the words
    are given up behind them, as they have become too many."""
    words, waiting, size = Words(), {}, 0

    def flush() -> Iterator[tuple[Words, np.ndarray, bool]]:
        made = [(lang, raws) for lang, raws in waiting.items()]
        waiting.clear()
        for k, (lang, raws) in enumerate(made):
            yield words, words.encode(lang, b"\n".join(raws)), k == len(made) - 1 and len(words.names) > REMEMBERED

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = prepared(text.as_py())
            waiting.setdefault(lang, []).append(raw)
            size += len(raw)
            if size >= CHUNK:
                yield from flush()
                size = 0
                if len(words.names) > REMEMBERED:
                    words = Words()
    yield from flush()


class _Lang(dict):
    def __init__(self, words: Words, lang: str) -> None:
        super().__init__({b"": _SKIP, b"\n": _BREAK})
        self.words, self.lang, self.seed = words, lang, seed_of(lang)

    def __missing__(self, name: bytes) -> int:
        number = self[name] = len(self.words.names)
        self.words.names.append(name)
        self.words.langs.append(self.lang)
        self.words.hashes.append(xxhash.xxh64_intdigest(name, self.seed))
        return number


def seed_of(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def mixed(hashes: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from those of their words, in order."""
    out = hashes[0]
    for h in hashes[1:]:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h
        out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, a) of the words in (lang, text); a row without phrase has the number of all words."""
    words, counts = None, np.zeros(0, np.int64)

    def flush() -> pa.RecordBatch:
        totals: dict[str, int] = {}
        for lang, n in zip(words.langs[2:], counts[2:].tolist(), strict=True):
            totals[lang] = totals.get(lang, 0) + n
        langs = [*words.langs[2:], *totals]
        names = [*words.names[2:], *[None] * len(totals)]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array([*counts[2:].tolist(), *totals.values()], pa.int64())], ["lang", "phrase", "a"])

    for words, numbers, last in encoded(batches):  # noqa: B007
        new = np.bincount(numbers, minlength=len(words.names)).astype(np.int64)
        new[: len(counts)] += counts
        counts = new
        if last:
            yield flush()
            counts = np.zeros(0, np.int64)
    if len(counts):
        yield flush()


def counted_phrases(batches: Iterator[pa.RecordBatch], k: int, bits: np.ndarray, shift: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, a) of the phrases of ``k`` words in (lang, text) of which both parts of ``k`` - 1 words may be frequent."""

    def count(words: Words, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
        hashes = np.array(words.hashes, np.uint64)
        for start in range(0, len(numbers) - k + 1, POSITIONS):
            part = numbers[start : start + POSITIONS + k - 1]
            n = len(part) - k + 1
            own = hashes[part]
            g = mixed([own[j : j + n + 1] for j in range(k - 1)]) >> np.uint64(shift)
            frequent = (bits[(g >> np.uint64(3)).astype(np.int64)] >> (g & np.uint64(7)).astype(np.uint8)) & 1 > 0
            use = frequent[:-1] & frequent[1:]
            for j in range(k):
                use &= part[j : j + n] != _BREAK
            at = np.flatnonzero(use)
            if not len(at):
                continue
            key = part[at].astype(np.int64)
            for j in range(1, k):
                pair = key << 32 | part[at + j]
                if j < k - 1:
                    _, key = np.unique(pair, return_inverse=True)
            _, first, times = np.unique(pair, return_index=True, return_counts=True)
            found = part[at[first][:, None] + np.arange(k)].tolist()
            phrases = [b" ".join([words.names[w] for w in row]) for row in found]
            langs = [words.langs[row[0]] for row in found]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], ["lang", "phrase", "a"])

    for words, numbers, _ in encoded(batches):
        yield from count(words, numbers)


def _filter(level: DataFrame) -> tuple[str, int]:
    """The name of a file for the executors with a bit set for every phrase of ``level``, and the hashes' shift."""
    count = level.count()
    size = min(FILTER_BITS, 1 << max(16, (count * BITS_EACH - 1).bit_length()))
    shift = 64 - (size.bit_length() - 1)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = {lang: seed_of(lang) for lang in set(batch.column(0).to_pylist())}
            rows = [[xxhash.xxh64_intdigest(w, seeds[lang]) for w in phrase.encode().split(b" ")] for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            hashes = np.array(rows, np.uint64)
            bit = mixed(list(hashes.T)) >> np.uint64(shift) if rows else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array((bit & np.uint64(63)).astype(np.int32))], ["word", "bit"])

    bits = level.select("lang", "phrase").mapInArrow(places, "word bigint, bit int")
    bits = bits.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))
    # Bounded: at most FILTER_BITS / 64 rows of two numbers.
    rows = bits.toArrow()
    out = np.zeros(size // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return send(level.sparkSession, out.astype("<i8").tobytes(), "phrases"), shift


def levels(docs: DataFrame, text: str = "text", lang: str = "lang", minimum: int = MINIMUM, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n), the numbers of all words, and for 1 to ``longest`` words the phrases (lang, phrase, a) that occur
    ``minimum`` times at least."""
    ship_package(docs.sparkSession)
    texts = docs.filter(F.col(text).isNotNull()).select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    schema, summed = "lang string, phrase string, a bigint", F.sum("a").alias("a")
    words = cut(texts.mapInArrow(counted_words, schema).groupBy("lang", "phrase").agg(summed).filter(F.col("phrase").isNull() | (F.col("a") >= minimum)))
    totals = cut(words.filter("phrase IS NULL").select("lang", F.col("a").alias("n")))
    out = [words.filter("phrase IS NOT NULL")]
    for k in range(2, longest + 1):
        if out[-1].isEmpty():
            break
        name, shift = _filter(out[-1])

        def phrases(batches: Iterator[pa.RecordBatch], k: int = k, name: str = name, shift: int = shift) -> Iterator[pa.RecordBatch]:
            bits = held(("phrases", name), lambda: np.frombuffer(Path(SparkFiles.get(name)).read_bytes(), np.uint8))
            return counted_phrases(batches, k, bits, shift)

        out.append(cut(texts.mapInArrow(phrases, schema).groupBy("lang", "phrase").agg(summed).filter(F.col("a") >= minimum)))
    return totals, out


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    a, n, left, right = (c.cast("decimal(18,0)") for c in (a, n, left, right))
    over, under = (a * n * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"), (left * right).cast("decimal(38,0)")
    return F.call_function("div", over, under)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", minimum: int = MINIMUM, longest: int = LONGEST, reported: int = REPORTED) -> DataFrame:
    """The first ``reported`` phrases of every language by the score of their weakest cut."""
    totals, found = levels(docs, text, lang, minimum, longest)
    facts = functools.reduce(DataFrame.union, found)
    longer = functools.reduce(DataFrame.union, found[1:], found[0].limit(0))
    # A phrase inside a longer one that is as frequent is also inside one that is longer by a word and as frequent.
    words = F.split("phrase", " ")
    inner = longer.withColumn("w", words).filter(F.size("w") > 2)
    inner = inner.select("lang", F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.size("w") - 1), " "))).alias("phrase"), F.col("a").alias("most"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    whole = longer.join(inner, ["lang", "phrase"], "left").filter("most IS NULL OR most < a").drop("most")

    cuts = whole.join(totals, "lang").withColumn("w", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.withColumns({"first": F.array_join(F.slice("w", F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ")}).drop("w")
    cuts = cuts.join(facts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(facts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    scored = cuts.withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    ranked = numbered(weakest.select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r"), ["lang"], F.desc("score"), F.desc("a"), F.asc("phrase"))
    top = ranked.filter(F.col("pos") < reported)
    return top.select("lang", (F.col("pos") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH pieces AS (
    SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n-\\r]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
facts AS (
    SELECT lang, k, phrase, count(*) AS a
    FROM (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, {LONGEST + 1}) AS ks(k)))
    GROUP BY ALL HAVING count(*) >= {MINIMUM}),
whole AS (
    SELECT * FROM facts f
    WHERE k >= 2 AND NOT EXISTS (SELECT 1 FROM facts g WHERE g.lang = f.lang AND g.k > f.k AND 100 * g.a >= 100 * f.a AND contains(' ' || g.phrase || ' ', ' ' || f.phrase || ' '))),
cuts AS (SELECT lang, phrase, a, k, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM whole),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.c, l.a AS l, r.a AS r, n, ((1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
    FROM cuts c JOIN totals USING (lang)
    JOIN facts l ON l.lang = c.lang AND l.phrase = array_to_string(w[1 : c.c], ' ')
    JOIN facts r ON r.lang = c.lang AND r.phrase = array_to_string(w[c.c + 1 :], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM weakest)
SELECT * FROM ranked WHERE rank <= {REPORTED}
"""

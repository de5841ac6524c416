"""Substring dedup by paragraphs.

Paragraphs are the lines of a text and, in lines of more than LONG_LINE words, also parts between cuts that the words
themselves choose (the smallest shingle hash of every LONG_WINDOW).  They meet by MinHash bands and are confirmed by
the exact Jaccard similarity of their shingles: each with the first paragraph of its band, and then, in bands that
still hold several components, each with every paragraph of another component, in blocks inside tasks.  Links make
components, whose first paragraph, by doc_id and place, stays.

A passage inside a longer line is too small a part of its paragraph to make it similar, and one over several short
lines is no paragraph.  So texts of PIECED words and more are also cut into pieces, whatever their lines (the smallest
shingle hash of every CUT_WINDOW), which are too short for MinHash and meet by equal wording, by a 64-bit hash.

Overlapping paragraphs and pieces are merged to runs; a passage of more than 50 words holds a run of at least
MINIMUM_RUN words.

Places are word positions, end exclusive.  A paragraph counts as repeated if another document has it.

Cases: null, empty and very short texts have no paragraphs; texts of any length are read whole; rows that repeat a
doc_id, and null ids, are left alone; paragraphs repeated within one document only are not removed; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.minhash import SHINGLE, SIMILARITY, Shape, _mixed, _signature, missed_links, signature_factors
from tidemark.llm.sieve import sieved
from tidemark.session import cut, discard, ship_package, shuffles_freed, table

CUT_WINDOW, PIECED, MINIMUM_RUN = 16, 51, 19
LONG_LINE, LONG_WINDOW = 100, 64
#: Bands, and signature values of which the first is the band's key.  Two paragraphs at similarity s share a band with
#: probability 1 - (1 - s) ** BANDS: 0.9998 at 0.75.
BANDS, DEPTH = 6, 3
#: Signature values, of BANDS * DEPTH, in which a plausible pair agrees; a pair at 0.75 has fewer with probability 4e-5.
PLAUSIBLE = 6
BLOCK_WORDS = 500_000
#: Bytes of texts that are divided into words together.
TEXT_BYTES = 8 << 20
#: Shingles whose signature values are held at a time.
SIGNED_SHINGLES = 50_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


class Words(NamedTuple):
    """Texts one behind the other, as word places."""

    #: Shingle hashes at every place; those that reach into the next text are of no use.
    g: np.ndarray
    #: The place at which each line begins, and the end.
    lines: np.ndarray
    #: The place at which each text begins, and the end.
    texts: np.ndarray

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """The text that holds each place."""
        return np.searchsorted(self.texts, at, side="right") - 1


def in_words(texts: pa.Array) -> Words:
    """Words of ``texts``; equal ones are hashed once."""
    import xxhash

    lines = pc.split_pattern(pc.ascii_lower(pc.fill_null(texts, "")), "\n")
    words = pc.ascii_split_whitespace(lines.flatten())
    flat = words.flatten()
    full = pc.binary_length(flat).to_numpy() > 0
    starts = np.concatenate([[0], np.cumsum(full)])[words.offsets.to_numpy()]
    coded = flat.dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    h = known[coded.indices.to_numpy()[full]]
    g = np.full(max(0, len(h) - SHINGLE + 1), SHINGLE, np.uint64)
    for k in range(SHINGLE):
        g = _mixed(g * _BASE + h[k : len(g) + k])
    return Words(g, starts, starts[lines.offsets.to_numpy()])


def text_slices(texts: pa.Array) -> Iterator[slice]:
    """Rows of about TEXT_BYTES together."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(total):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TEXT_BYTES, side="right")))
        yield slice(at, upto)
        at = upto


def cuts(g: np.ndarray, ends: np.ndarray, window: int = CUT_WINDOW) -> np.ndarray:
    """Places that hold the smallest, leftmost shingle of some window; one at i ends at ``ends[i]`` or before."""
    hit = np.zeros(len(g), bool)
    for begin in range(0, max(1, len(g) - window + 1), BLOCK_WORDS):
        part = g[begin : begin + BLOCK_WORDS + window - 1]
        if len(part) < window:
            continue
        least, width = part & ~np.uint64(0xFFFFF) | np.arange(len(part), dtype=np.uint64), 1
        while width < window:
            step = min(width, window - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        inside = np.arange(begin, begin + len(least)) + window <= ends[begin : begin + len(least)]
        hit[begin + (least[inside] & np.uint64(0xFFFFF)).astype(np.int64)] = True
    return np.flatnonzero(hit)


def distinct_in(g: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The number of different values in each of g[begin:end]."""
    order = np.argsort(g, kind="stable")
    same = np.flatnonzero(g[order[1:]] == g[order[:-1]])
    again, before = order[same + 1], order[same]
    by = np.argsort(again)
    again, before = again[by], before[by]
    low, high = np.searchsorted(again, begin), np.searchsorted(again, end)
    sizes = high - low
    unit = np.repeat(np.arange(len(begin)), sizes)
    used = np.arange(len(unit)) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
    return end - begin - np.bincount(unit[before[used] >= begin[unit]], minlength=len(begin))


def signatures_of(g: np.ndarray, begin: np.ndarray, end: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One signature for each of g[begin:end], which are not empty; many at a time."""
    out = np.zeros((len(begin), len(factors)), np.int32)
    at = 0
    while at < len(begin):
        upto = at + max(1, int(np.searchsorted(np.cumsum(end[at:] - begin[at:]), SIGNED_SHINGLES)))
        b, e = begin[at:upto], end[at:upto]
        if len(b) == 1:
            out[at] = _signature(g[b[0] : e[0]], factors)
        else:
            sizes = e - b
            starts = np.cumsum(sizes) - sizes
            used = np.repeat(b - starts, sizes) + np.arange(int(sizes.sum()))
            least = np.minimum.reduceat(g[used][:, None] * factors, starts, axis=0)
            out[at:upto] = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
        at = upto
    return out


def _run_hashes(g: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of g[first:last] for every pair of bounds."""
    power = _powers(_BASE, len(g))
    # sum of g[i] * base ** i, divided by base ** first through its inverse modulo 2 ** 64
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(g * power[:-1])])
    inverse = _powers(np.uint64(pow(int(_BASE), -1, 2**64)), len(g))
    return _mixed((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64)).view(np.int64)


def units(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, start, stop, x, n, signature): pieces, and paragraphs, which alone have signatures and n shingles."""

    def places(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last + 1 shingle of pieces and of paragraphs."""
        begin, end = w.lines[:-1], w.lines[1:] - SHINGLE + 1
        words, sizes = np.diff(w.lines), np.diff(w.texts)
        line = words >= SHINGLE
        ends = np.repeat(w.texts[1:] - SHINGLE + 1, sizes)

        def between(at: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
            """Neighbouring cuts of a long text, of which one at least is in a line of ``least`` words or more."""
            long, text = words[np.searchsorted(w.lines, at, side="right") - 1] >= least, w.text_of(at)
            used = (long[:-1] | long[1:]) & (text[:-1] == text[1:]) & (sizes[text[:-1]] >= PIECED)
            return at[:-1][used], at[1:][used] + 1

        first, last = between(cuts(w.g, ends))
        more, most = between(cuts(w.g, ends, LONG_WINDOW), LONG_LINE + 1)
        inner = most <= end[np.searchsorted(w.lines, more, side="right") - 1]
        return first, last, np.concatenate([begin[line], more[inner]]), np.concatenate([end[line], most[inner]])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = signature_factors(BANDS * DEPTH)
        names = ["doc_id", "start", "stop", "x", "n", "signature"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        for batch in batches:
            for rows in text_slices(batch.column(1)):
                w, ids = in_words(batch.column(1)[rows]), batch.column(0)[rows].to_numpy()
                first, last, begin, end = places(w)
                starts, stops = np.concatenate([first, begin]), np.concatenate([last, end])
                text = w.text_of(starts)
                n = np.concatenate([np.zeros(len(first), np.int64), distinct_in(w.g, begin, end)])
                made = [ids[text], starts - w.texts[text], stops + SHINGLE - 1 - w.texts[text], _run_hashes(w.g, starts, stops), n]
                columns = [pa.array(c, kind) for c, kind in zip(made, types, strict=True)]
                sizes = np.repeat([0, len(factors)], [len(first), len(begin)])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                values = pa.array(signatures_of(w.g, begin, end, factors).ravel(), pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, values, mask=pa.array(sizes == 0, pa.bool_())))
                yield pa.RecordBatch.from_arrays(columns, names)

    ship_package(docs.sparkSession)
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), text)
    return rows.mapInArrow(made, "doc_id bigint, start int, stop int, x bigint, n int, signature array<int>")


def _plausible_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose signatures agree in PLAUSIBLE values."""
    for batch in batches:
        s, t = (batch.column(k).flatten().to_numpy().reshape(len(batch), BANDS * DEPTH) for k in (2, 3))
        yield batch.select(["a", "b"]).filter(pa.array((s == t).sum(axis=1) >= PLAUSIBLE))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sets of shingles reach the similarity."""
    for batch in batches:
        near = []
        for s, t in zip(batch.column(2), batch.column(3), strict=True):
            p, q = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
            both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
            near.append(100 * both >= SIMILARITY * (len(p) + len(q) - both))
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def met_lines(lines: DataFrame) -> DataFrame:
    """(band, tree, id, a, z): the bands of ``lines`` (x, signature) that several wordings share, and each one's smallest and largest."""
    firsts = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.get("signature", k * DEPTH)))
    keyed = lines.select(F.col("x").alias("id"), F.posexplode(firsts).alias("tree", "band"))
    # Most bands have one wording.  They go before any paragraph moves.
    shared = cut(keyed.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z"))
    met = cut(sieved(keyed, "band", shared.select("band")).join(shared, "band").distinct())
    discard(shared)
    return met


def _line_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, shingles) of the places of each text whose wording is that of the id."""
    for batch in batches:
        for rows in text_slices(batch.column(0)):
            w = in_words(batch.column(0)[rows])
            text, at = _flat(batch.column(1)[rows])
            x, first, last = at["id"], at["start"] + w.texts[text], at["stop"] + w.texts[text] - SHINGLE + 1
            # Another text with the same doc_id may be shorter, or have other words there.
            held = np.flatnonzero(last + SHINGLE - 1 <= w.texts[text + 1])
            held = held[_run_hashes(w.g, first[held], last[held]) == x[held]]
            sets = [np.unique(w.g[i:j]).tobytes() for i, j in zip(first[held].tolist(), last[held].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x[held], pa.int64()), pa.array(sets, pa.binary())], ["id", "shingles"])


def line_sets(places: DataFrame, wanted: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(id, shingles), the sorted hashes as bytes, of ``wanted`` (id); ``places`` is (id, doc_id, start, stop)."""
    per_doc = cut(places.join(wanted, "id").groupBy("doc_id").agg(F.collect_list(F.struct("id", "start", "stop")).alias("places")))
    held = sieved(docs.select("doc_id", F.col(text).alias("whole")), "doc_id", per_doc.select("doc_id"))
    return held.join(per_doc, "doc_id").select("whole", "places").mapInArrow(_line_sets, "id bigint, shingles binary")


def similar_lines(met: DataFrame, signed: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Confirmed links (a, b) between the first line of a band and the others; ``signed`` is (id, doc_id, start, stop, n, signature)."""
    pairs = met.filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    of_a, of_b = signed.select(F.col("id").alias("a"), F.col("n").alias("p"), F.col("signature").alias("s")), signed.select(F.col("id").alias("b"), F.col("n").alias("q"), F.col("signature").alias("t"))
    # Sets too different in size cannot reach the similarity.
    both = pairs.join(of_a, "a").join(of_b, "b").filter(100 * F.least("p", "q") >= SIMILARITY * F.greatest("p", "q"))
    pairs = cut(both.select("a", "b", "s", "t").mapInArrow(_plausible_pairs, "a bigint, b bigint"))
    used = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = cut(line_sets(signed.select("id", "doc_id", "start", "stop"), used, docs, text))
    both = pairs.join(sets.toDF("a", "s"), "a").join(sets.toDF("b", "t"), "b").select("a", "b", "s", "t")
    links = cut(both.mapInArrow(_confirmed, "a bigint, b bigint"))
    discard(pairs, sets)
    return links


def line_components(lines: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, component) of the ``lines`` (doc_id, start, stop, x, n, signature) that are linked to another wording x."""
    met = met_lines(lines)
    used = cut(met.select("id").distinct())
    # A wording's shingles are the same in all its places, so that those of its first place will do.
    wordings = sieved(lines, "x", used).groupBy(F.col("x").alias("id")).agg(F.min(F.struct("doc_id", "start", "stop", "n", "signature")).alias("first"))
    signed = cut(wordings.join(used, "id").select("id", "first.*"))
    discard(used)
    first = cut(connected_components(similar_lines(met, signed, docs, text)))
    # The only pair of a band of two has been compared.
    more = cut(met.filter("id <> a AND id <> z").select("band").distinct())
    crowded = sieved(met.select("id", "tree", "band"), "band", more).join(more, "band")
    keyed = crowded.select("id", "tree", F.col("band").alias("region")).join(signed.select("id", F.col("n").cast("long").alias("n")), "id").join(first, "id", "left")
    keyed = cut(keyed.select("id", F.coalesce("component", "id").alias("component"), "n", "tree", "region"))
    discard(met, more)
    held = []

    def sets(wanted: DataFrame) -> DataFrame:
        # A table, so that the texts that were shuffled for it are gone when the sets are.
        held.append(cut(line_sets(signed.select("id", "doc_id", "start", "stop"), wanted, docs, text)))
        return held[-1]

    missed = missed_links(keyed, lambda wanted: signed.select("id", "signature").join(wanted, "id"), sets, Shape(BANDS, DEPTH, 1, PLAUSIBLE))
    missed = cut(missed)
    discard(keyed, signed, *held)
    later = cut(connected_components(missed).select("id", F.col("component").alias("whole")))
    moved = first.join(later.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
    return moved.union(later.join(first.select("id"), "id", "left_anti").select("id", "whole"))


def repeated_paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, start, stop, component_id, kept) of every paragraph and piece that another document has as well."""
    made = cut(units(docs, text))
    lines, pieces = made.filter("signature IS NOT NULL"), made.filter("signature IS NULL").drop("n", "signature")
    components = cut(line_components(lines, docs, text))
    placed = lines.select("doc_id", "start", "stop", "x").join(components.withColumnRenamed("id", "x"), "x", "left").select("doc_id", "start", "stop", F.coalesce("component", "x").alias("component_id"))

    def shared(rows: DataFrame) -> DataFrame:
        ends = cut(rows.groupBy("component_id").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last"))
        met = sieved(rows, "component_id", ends.select("component_id"))
        return met.join(ends, "component_id").select("doc_id", "start", "stop", "component_id", (F.col("doc_id") == F.col("first")).alias("kept"))

    return shared(cut(placed)).unionByName(shared(pieces.withColumnRenamed("x", "component_id")))


def _merged(of: np.ndarray, start: np.ndarray, stop: np.ndarray, minimum: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching places of each ``of`` merged, in order, if they have at least ``minimum`` words."""
    by = np.lexsort((start, of))
    of, start, stop = of[by], start[by].astype(np.int64), stop[by].astype(np.int64)
    if not len(of):
        return of, start, stop
    span = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + of * span) - of * span
    begins = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (start[1:] > reach[:-1])]))
    of, start, stop = of[begins], start[begins], reach[np.concatenate([begins[1:], [len(of)]]) - 1]
    long = stop - start >= minimum
    return of[long], start[long], stop[long]


def _flat(places: pa.Array) -> tuple[np.ndarray, dict]:
    """For each of the ``places``, structs in lists, the list and the fields."""
    flat = places.flatten()
    of = np.repeat(np.arange(len(places)), places.value_lengths().to_numpy())
    return of, {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def _runs(batches: Iterator[pa.RecordBatch], minimum: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of, at = _flat(batch.column(1))
        of, start, stop = _merged(of, at["start"], at["stop"], minimum)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], ["doc_id", "start", "stop"])


def merged_runs(found: DataFrame, minimum: int = MINIMUM_RUN) -> DataFrame:
    """(doc_id, start, stop) of overlapping or touching paragraphs merged, of at least ``minimum`` words."""
    per_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("places"))
    return per_doc.mapInArrow(partial(_runs, minimum=minimum), "doc_id bigint, start int, stop int")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document with runs, the words in them, and the words and places of the runs that are not kept."""
    for batch in batches:
        of, at = _flat(batch.column(1))
        every, start, stop = _merged(of, at["start"], at["stop"], MINIMUM_RUN)
        repeated = np.bincount(every, weights=stop - start, minlength=len(batch)).astype(np.int64)
        gone = ~at["kept"]
        which, start, stop = _merged(of[gone], at["start"][gone], at["stop"][gone], MINIMUM_RUN)
        removed = np.bincount(which, weights=stop - start, minlength=len(batch)).astype(np.int64)
        places: list[list[str]] = [[] for _ in range(len(batch))]
        for k, i, j in zip(which.tolist(), start.tolist(), stop.tolist(), strict=True):
            places[k].append(f"{i}:{j}")
        columns = [batch.column(0), pa.array(repeated), pa.array(removed), pa.array([",".join(p) for p in places], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_repeated", "n_removed", "removed"]).filter(pa.array(repeated > 0))


def op10_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document with a repeated passage: words in such passages, words to remove, and their places."""
    with shuffles_freed(spark):
        found = repeated_paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    per_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "kept")).alias("places"))
    return per_doc.mapInArrow(_summed, "doc_id bigint, n_repeated bigint, n_removed bigint, removed string")

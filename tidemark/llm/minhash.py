"""MinHash near-duplicates by an LSH forest.

Every document's set of word shingles gets one MinHash signature per tree of the forest.  In each tree the
signatures are sorted; documents next to each other there, and the first documents of the regions that share a
longest common prefix, are candidates.  A region that many documents share is cut at a deeper prefix.  Candidates
are confirmed on the full sets, and confirmed links make components.

That leaves pairs of a region that were never neighbours.  So every region which still holds several components is
compared whole, in blocks: first the signatures, then, of the documents in a plausible pair, the full sets inside the
task.  Pairs within one component are skipped, as they change nothing.  A crowded region is dealt to tasks by pairs of
blocks.

Equal sets are one node from the start, so a group of exact copies of any size costs one row per document.

Cases: a null or empty text, or one without words, has no shingles and links with nothing; a text of fewer words
than a shingle is one shingle; rows that repeat a doc_id are one document and get the same class on every row; a null
doc_id links with nothing and is kept; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.sieve import sieved
from tidemark.session import cut, discard, held, ship_package, table

SHINGLE = 5
SIMILARITY = 75
#: Trees, the depth at which a region starts, and the depth of whole signatures.  A pair at similarity s shares a
#: region of a tree with probability s ** START, and no region at s = 0.75 with probability 1.5e-4.
TREES, START, DEPTH = 16, 3, 5
#: A region with more documents than this is cut at full depth, and then into parts of this size.
REGION = 2000
#: Earlier neighbours in a sorted order that a document is compared with.
NEIGHBOURS = 2
#: Documents and shingles of a block, when a whole region is compared.
BLOCK, BLOCK_SHINGLES = 1000, 2_000_000
#: Signature values, of TREES * DEPTH, in which a plausible pair agrees; a pair at s = 0.75 has fewer with probability
#: 5e-6 at most.
PLAUSIBLE = 42
#: Rows of a small part, and rows of small parts that are compared together.
SMALL, TOGETHER = 16, 2000
MEMO_WORDS = 200_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def kept_words() -> dict:
    """The hashes of recent words, kept between the tasks of this worker."""
    return held(("words",), _Words)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: dict, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; ASCII letters are lower-cased, ASCII blanks divide words."""
    found = (text or "").encode().translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def signature_factors(count: int) -> np.ndarray:
    return _mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[at : at + 512, None] * factors).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, signature): the digest of the whole set and TREES * DEPTH MinHash values."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words, factors = kept_words(), signature_factors(TREES * DEPTH)
        for batch in batches:
            n, digests, sigs = [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), words)
                n.append(len(s))
                digests.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                sigs.append(_signature(s, factors))
            d = np.stack(digests) if digests else np.zeros((0, 2), np.int64)
            flat = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int32))
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * (TREES * DEPTH))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    ship_package(docs.sparkSession)
    return docs.select("doc_id", text).mapInArrow(made, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature array<int>")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of one task's sorted orders: the last few rows of the region, and the first row at each depth."""
    part = None
    recent: list[tuple] = []
    heads: list[tuple] = []
    for batch in batches:
        a, b = [], []
        parts, orders, ids, sizes = (batch.column(k).to_pylist() for k in range(4))
        for row in zip(parts, orders, ids, sizes, strict=True):
            if row[0] != part:
                part, recent, heads = row[0], [], [row] * (DEPTH + 1 - START)
            else:
                shared = next((k for k in range(START, DEPTH) if row[1][k] != heads[k - START][1][k]), DEPTH)
                met = {x[2]: x for x in (*recent, *heads[: shared + 1 - START])}
                for other in met.values():
                    low, high = sorted((row[3], other[3]))
                    if 100 * low >= SIMILARITY * high and other[2] != row[2]:
                        a.append(min(row[2], other[2]))
                        b.append(max(row[2], other[2]))
                heads[shared + 1 - START :] = [row] * (DEPTH - shared)
            recent = [*recent[-(NEIGHBOURS - 1) :], row]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def candidates(nodes: DataFrame) -> DataFrame:
    """Distinct candidate pairs (a, b) of ``nodes`` (id, n, signature)."""
    tree = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda k: F.slice("signature", k * DEPTH + 1, DEPTH)))
    rows = nodes.select("id", "n", tree.alias("tree", "order"))
    rows = rows.withColumn("region", F.xxhash64("tree", F.slice("order", 1, START)))
    crowded = cut(rows.groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("id", "n")).alias("head")).filter(F.col("members") > 1))
    # Rows alone in their region have no candidates and stop here, most of them before they move.
    rows = sieved(rows, "region", crowded.select("region")).join(crowded, "region")
    deeper = F.xxhash64("region", "order", F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / REGION)))
    part = F.when(F.col("members") > REGION, deeper).otherwise(F.col("region"))
    near = (
        rows.select(part.alias("part"), "order", "id", "n")
        .repartition("part")
        .sortWithinPartitions("part", "order", "id")
        .mapInArrow(_neighbours, "a bigint, b bigint")
    )
    similar = 100 * F.least("n", "head.n") >= SIMILARITY * F.greatest("n", "head.n")
    heads = rows.filter((F.col("members") > REGION) & (F.col("id") != F.col("head.id")) & similar).select(F.col("head.id").alias("a"), F.col("id").alias("b"))
    return near.union(heads).distinct()


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = kept_words()
    last, held = None, None
    for batch in batches:
        keep_a, keep_b = [], []
        for a, b, x, y in zip(*(batch.column(k) for k in range(4)), strict=True):
            if a.as_py() != last:
                last, held = a.as_py(), shingle_set(x.as_py(), words)
            other = shingle_set(y.as_py(), words)
            both = len(np.intersect1d(held, other, assume_unique=True))
            if 100 * both >= SIMILARITY * (len(held) + len(other) - both):
                keep_a.append(last)
                keep_b.append(b.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], ["a", "b"])


def confirm(pairs: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    used = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = sieved(docs.select("doc_id", F.col(text).alias("t")), "doc_id", used).join(used, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("t").alias("y")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("t").alias("x")), "a").select("a", "b", "x", "y")
    return both.mapInArrow(_confirmed, "a bigint, b bigint")


class Shape(NamedTuple):
    """How signatures make regions: trees, values of each, values that a region shares, and those of a plausible pair."""

    trees: int = TREES
    depth: int = DEPTH
    start: int = START
    plausible: int = PLAUSIBLE
    #: Whether n is the size of the set, so that sizes too far apart rule a pair out.
    sized: bool = True


_ROW = "part bigint, cross_blocks boolean, tree int, block bigint, id bigint, component bigint, n bigint, signature array<int>"


def _parts(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[list]:
    """The columns of _ROW, and of a last binary column if there is one, for one part after another."""
    held: list[list] = []
    for batch in batches:
        columns: list = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
        columns.append(batch.column(7).flatten().to_numpy().reshape(len(batch), shape.trees * shape.depth))
        columns += [np.array([*c.to_pylist(), None], object)[:-1] for c in batch.columns[8:]]
        bounds = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist(), len(batch)]
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            if begin == end:
                continue
            if held and held[0][0][0] != columns[0][begin]:
                yield [np.concatenate(c) if len(held) > 1 else c[0] for c in zip(*held, strict=True)]
                held = []
            held.append([c[begin:end] for c in columns])
    if held:
        yield [np.concatenate(c) if len(held) > 1 else c[0] for c in zip(*held, strict=True)]


def _plausible(part: list, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in a part: of two components, similar by size and signature, and in no region of an earlier tree."""
    _, cross_blocks, tree, block, _, component, n, signature = part[:8]
    m, earlier = len(n), int(tree[0])
    prefixes = signature.reshape(m, shape.trees, shape.depth)[:, :earlier, : shape.start]
    values = np.ascontiguousarray((signature & 255).astype(np.uint8).T) if m > 64 else None
    step = max(1, min(256, 1_000_000 // m))
    for at in range(0, m, step):
        of = slice(at, at + step)
        if values is None:
            agree = (signature[of, None] == signature[None]).sum(axis=2)
        else:
            agree = np.zeros((len(n[of]), m), np.uint8)
            for v in values:
                agree += v[of, None] == v
        ok = (agree >= shape.plausible) & (component[of, None] != component)
        if shape.sized:
            ok &= (100 * n[of, None] >= SIMILARITY * n) & (100 * n >= SIMILARITY * n[of, None])
        ok &= block[of, None] < block if cross_blocks[0] else np.arange(m)[of, None] < np.arange(m)
        rows, cols = np.nonzero(ok)
        rows += at
        first = np.ones(len(rows), bool)
        for k in range(earlier):
            first &= (prefixes[rows, k] != prefixes[cols, k]).any(axis=1)
        yield rows[first], cols[first]


def _in_small_parts(parts: list[list], shape: Shape) -> np.ndarray:
    """For parts of one size and tree, of one block each, whether each row is in a plausible pair, as in `_plausible`."""
    tree, m = int(parts[0][2][0]), len(parts[0][0])
    component, n = (np.stack([p[k] for p in parts]) for k in (5, 6))
    signature = np.stack([p[7] for p in parts])
    used = np.zeros(component.shape, bool)
    step = max(1, 4_000_000 // (m * m * shape.trees * shape.depth))
    for at in range(0, len(parts), step):
        s, c, size = signature[at : at + step], component[at : at + step], n[at : at + step]
        ok = (s[:, :, None] == s[:, None]).sum(axis=3) >= shape.plausible
        ok &= c[:, :, None] != c[:, None]
        if shape.sized:
            ok &= (100 * size[:, :, None] >= SIMILARITY * size[:, None]) & (100 * size[:, None] >= SIMILARITY * size[:, :, None])
        for k in range(tree):
            prefix = s[:, :, k * shape.depth : k * shape.depth + shape.start]
            ok &= (prefix[:, :, None] != prefix[:, None]).any(axis=3)
        used[at : at + step] = ok.any(axis=1)  # a pair counts both ways
    return used.ravel()


def _unsettled(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    """The rows that are in a plausible pair of their part; small parts of one size and tree are compared together."""
    kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in _ROW.split(", ")]

    def kept(rows: list, used: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(used):
            columns = [pa.array(c[used], kind) for c, kind in zip(rows[:7], kinds, strict=True)]
            offsets = pa.array(np.arange(len(used) + 1, dtype=np.int32) * (shape.trees * shape.depth))
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(rows[7][used].ravel(), pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    def together(parts: list[list]) -> Iterator[pa.RecordBatch]:
        yield from kept([np.concatenate(c) for c in zip(*parts, strict=True)], np.flatnonzero(_in_small_parts(parts, shape)))

    waiting: dict[tuple[int, int], list[list]] = {}
    for part in _parts(batches, shape):
        m = len(part[0])
        if m > SMALL or part[1][0]:
            yield from kept(part, np.unique(np.concatenate([x for pair in _plausible(part, shape) for x in pair])))
        elif m > 1:
            same = waiting.setdefault((m, int(part[2][0])), [])
            same.append(part)
            if m * len(same) > TOGETHER:
                yield from together(waiting.pop((m, int(part[2][0]))))
    for same in waiting.values():
        yield from together(same)


def _settled(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    """Links between components of a part that a pair of full sets confirms; at most one for each row."""
    for part in _parts(batches, shape):
        sets = [np.frombuffer(s, np.uint64) for s in part[8]]
        sizes = np.array([len(s) for s in sets])
        known, dense = np.unique(np.concatenate(sets), return_inverse=True)
        dense = np.split(dense, np.cumsum(sizes)[:-1])
        component, label, held = part[5], part[5].copy(), np.zeros(len(known), bool)
        a, b = [], []
        for rows, cols in _plausible(part, shape):
            for row, others in zip(*_runs(rows, cols), strict=True):
                others = others[label[others] != label[row]]
                if not len(others):
                    continue
                held[dense[row]] = True
                starts = np.cumsum(sizes[others]) - sizes[others]
                both = np.add.reduceat(held[np.concatenate([dense[k] for k in others])].astype(np.int64), starts)
                held[dense[row]] = False
                near = others[100 * both >= SIMILARITY * (sizes[row] + sizes[others] - both)]
                for other in near:
                    if label[other] != label[row]:
                        a.append(component[row])
                        b.append(component[other])
                        label[label == label[other]] = label[row]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _runs(rows: np.ndarray, cols: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The different ``rows``, which are sorted, and the ``cols`` of each."""
    if not len(rows):
        return [], []
    bounds = np.flatnonzero(np.diff(rows)) + 1
    return rows[[0, *bounds]].tolist(), np.split(cols, bounds)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = kept_words()
    for batch in batches:
        sets = pa.array([shingle_set(t.as_py(), words).tobytes() for t in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["id", "shingles"])


def missed_links(keyed: DataFrame, signed: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame], shape: Shape) -> DataFrame:
    """Links (a, b) between components whose members share a region.

    ``keyed`` is (id, component, n, tree, region), and of wanted ids ``signed`` gives (id, signature) and ``sets``
    (id, shingles), the sorted hashes as bytes.
    """
    mixed = keyed.groupBy("region").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("words"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("words") / BLOCK_SHINGLES))
    mixed = cut(mixed.filter("c < d").select("region", blocks.alias("blocks")))
    places = cut(sieved(keyed, "region", mixed.select("region")).join(mixed, "region"))
    # Every block meets every block, itself included, in one part.
    dealt = places.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    part = F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other"))
    rows = dealt.select(part.alias("part"), (F.col("block") != F.col("other")).alias("cross_blocks"), "tree", "block", "id", "component", "n")
    signatures = cut(signed(places.select("id").distinct()))
    rows = rows.join(signatures, "id").select([x.split()[0] for x in _ROW.split(", ")])
    unsettled = cut(rows.repartition("part").sortWithinPartitions("part").mapInArrow(partial(_unsettled, shape=shape), _ROW))
    discard(mixed, places, signatures)
    whole = unsettled.join(sets(unsettled.select("id").distinct()), "id").select(*unsettled.columns, "shingles")
    return whole.repartition("part").sortWithinPartitions("part").mapInArrow(partial(_settled, shape=shape), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``."""
    sets = cut(signatures(docs, text))
    nodes = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")
    )
    nodes = cut(nodes)
    links = confirm(cut(candidates(nodes.select("id", "n", "signature"))), docs, text)
    components = connected_components(links)
    placed = cut(nodes.join(components, "id", "left").withColumn("component", F.coalesce("component", "id")))
    tree = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda k: F.xxhash64(k, F.slice("signature", k * DEPTH + 1, START))))

    def full_sets(used: DataFrame) -> DataFrame:
        used = cut(used.toDF("doc_id"))
        texts = sieved(docs.select("doc_id", text), "doc_id", used).join(used, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        return texts.mapInArrow(_full_sets, "id bigint, shingles binary")

    missed = missed_links(placed.select("id", "component", "n", tree.alias("tree", "region")), lambda wanted: placed.select("id", "signature").join(wanted, "id"), full_sets, Shape())
    joined_later = connected_components(cut(missed))
    classes = placed.join(joined_later.select(F.col("id").alias("component"), F.col("component").alias("whole")), "component", "left")
    classes = classes.select("set_a", "set_b", F.coalesce("whole", "component").alias("component"))
    joined = sets.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", F.coalesce(component, F.col("doc_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def op9_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))

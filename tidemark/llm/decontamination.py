"""Benchmark decontamination by edit distance.

Windows as long as an item stand in every text wherever at least half as many of the item's pieces as a leak must
leave untouched lie on nearly one diagonal; this only orders the work and loses no leak.  CGK random walks embed
windows and items so that few edits become few differing places; repeated samples of these places are LSH keys, and
windows that share a key with an item are verified by exact edit distance.

Items of fewer than WALKED characters allow two edits at most.  Their walks are too short to be sampled, so of their
pieces, one more than edits, one that is untouched leads to verification.

Letters are compared in lower case and every white space as a blank.

Cases: null and empty texts hold no leaks; items that are null or shorter than SHORTEST characters, which any text
may hold by chance, are not looked for; texts of any length are read whole; items that repeat under several ids are
all reported; an empty benchmark reports nothing; of several places in a document the nearest, then the first, is
reported; rows without a doc_id are reported with a null id; other columns pass through ``drop_leaks`` untouched.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import held, send, ship_package, table

#: Edits allowed per character of the item, and the length of the pieces that may stay untouched.
DISTANCE, PIECE, WALKED, SHORTEST = 0.1, 8, 24, 8
#: Random walks, samples per walk, places per sample.  At 10 % edits about six in ten places agree, so a window shares
#: no key with its item with probability (1 - 0.6 ** 4) ** 160 if samples were independent; those of one walk are not,
#: so the number of walks decides: tests/llm/test_brute.py asks for 0.99 of the leaks.
WALKS, SAMPLES, PLACES = 8, 20, 4
#: Benchmark characters that go along with one pass over the documents; larger benchmarks take several passes.
PASS_CHARS = 8_000_000
BLOCK_CHARS, WINDOW_BLOCK = 2_000_000, 2_000
_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_PIECE_BITS = 22


def folded(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    for c in _BLANKS[:9] if low.isascii() else _BLANKS:
        low = low.replace(c, " ")
    return low


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def piece_hashes(x: np.ndarray, size: int = PIECE) -> np.ndarray:
    if len(x) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(x) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + x[k : len(x) - size + 1 + k] + np.uint64(1)
    return out * np.uint64(0xD6E8FEB86659FD93)


def edit_search(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to any part of ``text``, end of the first such part); bit-parallel."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        plus, minus = down | ~(d0 | up) & full, up & d0
        score += 1 if plus & top else -1 if minus & top else 0
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(d0 | plus) & full, plus & d0
        if score < best:
            best, end = score, at + 1
    return best, end


def locate(pattern: str, text: str, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the nearest part of ``text``, if it is within ``most`` edits."""
    distance, end = edit_search(pattern, text)
    if distance > most:
        return None
    _, back = edit_search(pattern[::-1], text[:end][::-1])
    return distance, end - back, end


class Walks:
    """CGK embeddings: at each step a walk shows a character and moves on or stays by a coin that the step and the
    character decide, so walks over near texts fall into step again after each edit.  A walk takes twice as many
    steps as its item has characters; a key is what the walk shows at a few sampled places."""

    def __init__(self, longest: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.coins = rng.integers(0, 2, (2 * longest, WALKS, 256), dtype=np.int64)
        self.places = rng.random((WALKS * SAMPLES, PLACES))
        self.salt = rng.integers(1, 2**63, (WALKS * SAMPLES, PLACES), dtype=np.uint64) | np.uint64(1)

    def keys(self, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(windows, WALKS * SAMPLES) keys of the windows, which come longest first."""
        n, steps = len(starts), 2 * lengths
        at = np.repeat(starts[None, :], WALKS, axis=0)
        ends = np.minimum(starts + lengths, len(x))
        shown = np.zeros((int(steps.max(initial=0)), WALKS, n), np.uint32)
        walk = np.arange(WALKS)[:, None]
        padded = np.append(x, np.uint32(0))
        for step in range(len(shown)):
            live = int(np.searchsorted(-steps, -step))
            here = at[:, :live]
            c = padded[np.where(here < ends[:live], here, len(x))]
            shown[step, :, :live] = c
            here += self.coins[step][walk, (c ^ c >> np.uint32(8)) & np.uint32(255)]
        out = np.zeros((n, WALKS * SAMPLES), np.uint64)
        each = np.arange(n)
        for k in range(WALKS * SAMPLES):
            for p in range(PLACES):
                out[:, k] = (out[:, k] ^ shown[(self.places[k, p] * steps).astype(np.int64), k // SAMPLES, each]) * self.salt[k, p]
        return out


class Pieces:
    """Pieces of one size of some items, by hash; every item has a piece at each multiple of the size."""

    def __init__(self, size: int, of: list[int], texts: list[str]):
        self.size, hashes, owners, offsets = size, [], [], []
        for k in of:
            h = piece_hashes(codes(texts[k]), size)[::size]
            hashes.append(h)
            owners.append(np.full(len(h), k))
            offsets.append(np.arange(len(h)) * size)
        order = np.argsort(np.concatenate(hashes), kind="stable")
        self.hashes, self.owners, self.offsets = (np.concatenate(v)[order] for v in (hashes, owners, offsets))
        self.present = np.zeros(1 << _PIECE_BITS, bool)
        self.present[self.hashes >> np.uint64(64 - _PIECE_BITS)] = True

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, start): where an item would start for one of its pieces to stand where it does; ordered."""
        h = piece_hashes(x, self.size)
        at = np.flatnonzero(self.present[h >> np.uint64(64 - _PIECE_BITS)])
        low, high = (np.searchsorted(self.hashes, h[at], side) for side in ("left", "right"))
        times = high - low
        at, low, times = at[times > 0], low[times > 0], times[times > 0]
        entry = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        item, start = self.owners[entry], np.repeat(at, times) - self.offsets[entry]
        order = np.lexsort((start, item))
        return item[order], start[order]


class Items:
    """The benchmark of one pass, with its pieces and LSH keys."""

    def __init__(self, rows: tuple[tuple[int, str], ...]):
        self.ids = [i for i, _ in rows]
        self.texts = [t for _, t in rows]
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.lengths, self.edits = lengths, np.floor(lengths * DISTANCE).astype(np.int64)
        walked = lengths >= WALKED
        # Every edit touches at most one piece (a deletion between two touches none); half of the others are asked for.
        self.needed = np.where(walked, np.maximum(1, (lengths // PIECE - self.edits + 1) // 2), 1)
        sizes = np.where(walked, PIECE, np.minimum(PIECE, lengths // (self.edits + 1)))
        self.pieces = [Pieces(int(size), np.flatnonzero(sizes == size).tolist(), self.texts) for size in np.unique(sizes)]
        self.walks = Walks(int(lengths.max()))
        whole = np.concatenate([codes(t) for t in self.texts])
        first = np.cumsum(lengths) - lengths
        longest = np.argsort(-lengths, kind="stable")
        self.keys = np.zeros((len(rows), WALKS * SAMPLES), np.uint64)
        self.keys[longest] = self.walks.keys(whole, first[longest], lengths[longest])

    def windows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, start) where enough pieces of an item stand within twice its edits of one diagonal."""
        items, starts = [], []
        for pieces in self.pieces:
            item, start = pieces.hits(x)
            last = np.arange(len(item)) + self.needed[item] - 1
            inside = np.minimum(last, max(0, len(item) - 1))
            fits = (last < len(item)) & (item[inside] == item) & (start[inside] - start <= 2 * self.edits[item])
            item, start = item[fits], start[fits]
            apart = 3
            new = np.ones(len(item), bool)
            new[1:] = (item[1:] != item[:-1]) | (start[1:] // apart != start[:-1] // apart)
            items.append(item[new])
            starts.append(np.maximum(start[new], 0))
        return np.concatenate(items), np.concatenate(starts)

    def candidates(self, x: np.ndarray) -> list[tuple[int, int]]:
        """(item, start) of windows that share an LSH key with their item, and all those of short items."""
        item, start = self.windows(x)
        short = self.lengths[item] < WALKED
        out = list(zip(item[short].tolist(), start[short].tolist(), strict=True))
        item, start = item[~short], start[~short]
        for at in range(0, len(item), WINDOW_BLOCK):
            i, s = item[at : at + WINDOW_BLOCK], start[at : at + WINDOW_BLOCK].astype(np.int64)
            order = np.argsort(-self.lengths[i], kind="stable")
            i, s = i[order], s[order]
            near = (self.walks.keys(x, s, self.lengths[i]) == self.keys[i]).any(axis=1)
            out += zip(i[near].tolist(), s[near].tolist(), strict=True)
        return out


def leaks_in(texts: list[str], items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, start, end): the nearest place of every item that leaks into a text."""
    x = codes("\0".join(texts))
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    # Windows of an item that overlap are searched as one.
    wide: dict[tuple[int, int], list[list[int]]] = {}
    for k, s in sorted(items.candidates(x)):
        n, slack = int(items.lengths[k]), int(items.edits[k]) + 3
        doc = int(np.searchsorted(bounds, min(s + n // 2, bounds[-1] - 1), "right")) - 1
        low, high = max(0, s - int(bounds[doc]) - slack), s - int(bounds[doc]) + n + 2 * slack
        known = wide.setdefault((doc, k), [])
        if known and low <= known[-1][1]:
            known[-1][1] = max(known[-1][1], high)
        else:
            known.append([low, high])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for (doc, k), windows in wide.items():
        for low, high in windows:
            place = locate(items.texts[k], texts[doc][low:high], int(items.edits[k]))
            if place:
                found = (place[0], low + place[1], low + place[2])
                best[doc, k] = min(found, best.get((doc, k), found))
    return [(doc, k, *v) for (doc, k), v in sorted(best.items())]


def benchmark_passes(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> list[tuple[tuple[int, str], ...]]:
    """The usable items, folded, in groups of at most PASS_CHARS characters.

    The benchmark is a fixed test set; its items are read one partition at a time and never more than a pass is sent.
    """
    passes, rows, chars = [], [], 0
    usable = benchmark.filter(F.col(text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).alias("i"), F.col(text).alias("t")).distinct()
    for r in usable.orderBy("i", "t").toLocalIterator():
        t = folded(r["t"])
        if len(t) < SHORTEST:
            continue
        if rows and chars + len(t) > PASS_CHARS:
            passes.append(tuple(rows))
            rows, chars = [], 0
        rows.append((r["i"], t))
        chars += len(t)
    return [*passes, *([tuple(rows)] if rows else [])]


def _blocks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of a batch, about BLOCK_CHARS characters at a time, with the first one's place."""
    texts, first, chars = [], 0, 0
    for k, t in enumerate(column):
        texts.append(folded(t.as_py() or ""))
        chars += len(texts[-1])
        if chars >= BLOCK_CHARS:
            yield first, texts
            texts, first, chars = [], k + 1, 0
    if texts:
        yield first, texts


def _passes(spark: SparkSession, benchmark: DataFrame) -> list[str]:
    """The benchmark's passes as files that Spark hands to every executor; their names there."""
    names = []
    for rows in benchmark_passes(benchmark):
        content = json.dumps(rows).encode()
        names.append(send(spark, content, "benchmark"))
    return names


def _items(name: str) -> Items:
    return held(("benchmark", name), lambda: Items(tuple((i, t) for i, t in json.loads(Path(SparkFiles.get(name)).read_text()))))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start, end) for every item within the distance of a part of a document."""
    ship_package(docs.sparkSession)
    out = docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, distance bigint, start bigint, end bigint")
    for name in _passes(docs.sparkSession, benchmark):

        def found(batches: Iterator[pa.RecordBatch], name=name) -> Iterator[pa.RecordBatch]:
            items = _items(name)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                hits = [(ids[first + doc], items.ids[k], *rest) for first, texts in _blocks(batch.column(1)) for doc, k, *rest in leaks_in(texts, items)]
                yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], pa.int64()) for k in range(5)], ["doc_id", "item_id", "distance", "start", "end"])

        out = out.union(docs.select("doc_id", text).mapInArrow(found, out.schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the documents into which an item leaks."""
    ship_package(docs.sparkSession)
    at = docs.columns.index(text)
    for name in _passes(docs.sparkSession, benchmark):

        def clean(batches: Iterator[pa.RecordBatch], name=name) -> Iterator[pa.RecordBatch]:
            items = _items(name)
            for batch in batches:
                leaky = {first + hit[0] for first, texts in _blocks(batch.column(at)) for hit in leaks_in(texts, items)}
                yield batch.filter(pa.array([k not in leaky for k in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))

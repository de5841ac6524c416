"""Removal of byte strings that occur twice, with suffix arrays.

A string of LENGTH bytes that occurs twice has the same smallest k-gram at the same place both times.  Every text is
therefore cut into fragments, one per such k-gram: all starts that have it as their smallest, and LENGTH bytes after
the last of them.  Fragments meet at their k-gram; k-grams that occur once end there.  Where different fragments
meet, their suffixes are sorted in two stages (those smaller than their successors directly, all others induced by
scanning the buckets), and neighbours with a common prefix of LENGTH bytes are repeated.

Fragments that are equal as wholes are repeated at every start, and equal texts are handled once.  A k-gram under
which more than GROUP different fragments meet is too much for one task.  Its fragments are cut into pieces of TILE
starts each, which meet at everything that the strings of such a piece have in common, LENGTH - TILE + 1 bytes; the
pieces of a group are suffix-sorted like fragments.  Only where more than GROUP different pieces share all of that,
single strings, which are TILE to a piece, are counted by their hash.

Hashes of whole fragments, pieces and strings have 128 bits and are not compared byte by byte.

Cases: a null text counts as empty; texts of fewer than LENGTH bytes lose nothing; rows that repeat a doc_id are
separate texts with one result each; a null doc_id is removed from as any other; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.minhash import _mixed
from tidemark.session import cut, ship_package, table

LENGTH, GRAM, GROUP, TILE = 400, 32, 1000, 16
SEGMENT = 4_000_000


def gram_hashes(x: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of all strings of ``size`` (a power of two) bytes, by doubling."""
    h, width, power = x.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while width < size:
        h = h[:-width] * np.uint64(power) + h[width:]
        power = power * power % 2**64
        width *= 2
    return _mixed(h)


def fragments_of(x: np.ndarray, length: int = LENGTH, size: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram, place, first, last): every smallest k-gram with the first and last start that has it as smallest."""
    parts = []
    for begin in range(0, len(x) - length + 1, SEGMENT):
        part = x[begin : begin + SEGMENT + length - 1]
        h = gram_hashes(part, size)
        least, width, window = h & ~np.uint64(0xFFFFFF) | np.arange(len(h), dtype=np.uint64), 1, length - size + 1
        while width < window:
            step = min(width, window - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        parts.append((h[place[first]].view(np.int64), begin + place[first], begin + first, begin + last))
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))


def ascending(t: np.ndarray) -> np.ndarray:
    """For every suffix, whether it is smaller than the suffix that starts one byte later."""
    n = len(t)
    differs = np.flatnonzero(t[:-1] != t[1:])
    following = np.searchsorted(differs, np.arange(n))
    out = np.zeros(n, bool)
    has = following < len(differs)
    at = differs[following[has]]
    out[has] = t[at] < t[at + 1]
    return out


def repeated_starts(fragments: list[bytes], length: int = LENGTH) -> list[list[int]]:
    """For every fragment, the starts whose ``length`` bytes also start elsewhere in ``fragments``.

    Two-stage suffix sorting over the starts that matter and, behind the last of them, as far as the next directly
    sorted suffix, from which it is induced.
    """
    direct: list[tuple[bytes, int, int]] = []
    smaller: list[list[bool]] = []
    ends: list[int] = []
    for f, b in enumerate(fragments):
        up = ascending(np.frombuffer(b, np.uint8))
        later = np.flatnonzero(up[len(b) - length :])
        end = len(b) - length + int(later[0]) if len(later) else len(b) - 1
        direct += [(b[i : i + length], f, i) for i in np.flatnonzero(up[: end + 1]).tolist()]
        if not len(later):  # nothing larger follows: the last suffix is where induction starts
            direct.append((b[end:], f, end))
        smaller.append(up.tolist())
        ends.append(end)
    direct.sort()
    sorted_direct: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    induced: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    for key, f, i in direct:
        # The very last suffix of a fragment is larger than the empty one after it, so it belongs to the induced ones.
        (sorted_direct if smaller[f][i] else induced)[key[0]].append((f, i))
    marked: list[set[int]] = [set() for _ in fragments]
    before: tuple[int, int] | None = None
    for c in range(256):
        for bucket in (induced[c], sorted_direct[c]):
            for f, i in bucket:  # the induced bucket grows while it is read
                b = fragments[f]
                if i and not smaller[f][i - 1]:
                    induced[b[i - 1]].append((f, i - 1))
                if i + length <= len(b):
                    if before is not None and fragments[before[0]][before[1] : before[1] + length] == b[i : i + length]:
                        marked[f].add(i)
                        marked[before[0]].add(before[1])
                    before = (f, i)
    return [sorted(m) for m in marked]


def _ranges(starts: list[int]) -> list[int]:
    """Bounds of the runs of consecutive numbers, both inclusive: first, last, first, last ..."""
    out: list[int] = []
    for s in starts:
        if out and out[-1] == s - 1:
            out[-1] = s
        else:
            out += [s, s]
    return out


_FRAGMENTS = "row bigint, n_bytes bigint, tx bigint, ty bigint, gram bigint, fx bigint, fy bigint, offset int, width int, firsts array<int>"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _fragment_rows(docs: DataFrame) -> DataFrame:
    """_FRAGMENTS: a text's different fragments, each with its k-gram's offset, its last start and all its places.

    Texts without any have one row of nulls.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = (t.as_py() or "").encode()
                whole = np.frombuffer(xxhash.xxh3_128_digest(b), np.int64).tolist()
                if len(b) < LENGTH:
                    for k, v in enumerate((row, len(b), *whole, None, None, None, None, None, None)):
                        out[k].append(v)
                    continue
                at: dict[tuple[int, bytes], list] = {}
                for gram, place, first, last in zip(*(v.tolist() for v in fragments_of(np.frombuffer(b, np.uint8))), strict=True):
                    at.setdefault((gram, xxhash.xxh3_128_digest(b[first : last + LENGTH])), [place - first, last - first, []])[2].append(first)
                digests = np.frombuffer(b"".join(d for _, d in at), np.int64)
                n = len(at)
                columns = ([row] * n, [len(b)] * n, [whole[0]] * n, [whole[1]] * n, [g for g, _ in at], digests[::2].tolist(), digests[1::2].tolist(), *zip(*at.values(), strict=True))
                for k, v in enumerate(columns):
                    out[k] += v
            kinds = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out, kinds, strict=True)], _names(_FRAGMENTS))

    ship_package(docs.sparkSession)
    return docs.mapInArrow(made, _FRAGMENTS)


_PIECES = "gram bigint, fx bigint, fy bigint, offset int, bytes binary"


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted fragments of each text."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for t, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            b = t.as_py().encode()
            for w in wanted:
                for k, v in enumerate((w["gram"], w["fx"], w["fy"], w["offset"], b[w["first"] : w["first"] + w["width"] + LENGTH])):
                    out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out, kinds, strict=True)], _names(_PIECES))


_TILES = "gram bigint, fx bigint, fy bigint, start int, key bigint, ux bigint, uy bigint, bytes binary"


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_TILES: a fragment's pieces of at most TILE starts, by the bytes that all strings of the piece have in common."""
    import xxhash

    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for gram, fx, fy, offset, b in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            # A string that starts d bytes before the k-gram belongs to tile d // TILE.
            for tile in range((offset - len(b) + LENGTH) // TILE, offset // TILE + 1):
                low, high = max(0, offset - TILE * tile - TILE + 1), min(len(b) - LENGTH, offset - TILE * tile)
                common = b[offset - TILE * tile : offset - TILE * tile + LENGTH - TILE + 1]
                piece = b[low : high + LENGTH]
                # Groups of one tile only: the digest holds which.
                key = int(np.frombuffer(xxhash.xxh3_64_digest(common, seed=tile), np.int64)[0])
                for k, v in enumerate((gram, fx, fy, low, key, *np.frombuffer(xxhash.xxh3_128_digest(piece), np.int64).tolist(), piece)):
                    out[k].append(v)
        kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out, kinds, strict=True)], _names(_TILES))


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated starts of the fragments of each k-gram; rows come ordered by k-gram."""

    def flush(group: list) -> tuple[list, list, list, list]:
        found = repeated_starts([g[3] for g in group])
        return tuple(zip(*[(g[0], g[1], g[2], _ranges(s)) for g, s in zip(group, found, strict=True) if s], strict=True)) or ((), (), (), ())

    def as_batch(rows: tuple) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(list(v), kind) for v, kind in zip(rows, kinds, strict=True)], ["gram", "fx", "fy", "ranges"])

    group: list = []
    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if group and r[0] != group[0][0]:
                yield as_batch(flush(group))
                group = []
            group.append(r)
    if group:
        yield as_batch(flush(group))


def _all_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of LENGTH bytes of a piece by hash: (key, ux, uy, start, sx, sy)."""
    import xxhash

    for batch in batches:
        for key, ux, uy, b in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            n = len(b) - LENGTH + 1
            d = np.frombuffer(b"".join([xxhash.xxh3_128_digest(b[s : s + LENGTH]) for s in range(n)]), np.int64)
            columns = [pa.array(np.full(n, v)) for v in (key, ux, uy)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(n, dtype=np.int32)), pa.array(d[::2]), pa.array(d[1::2])], ["key", "ux", "uy", "start", "sx", "sy"])


_RANGES = "gram bigint, fx bigint, fy bigint, ranges array<int>"


def _crowded_ranges(pieces: DataFrame, group: int) -> DataFrame:
    """_RANGES of the fragments of crowded k-grams; a fragment may have several rows."""
    tiles = cut(pieces.mapInArrow(_tiled, _TILES))
    kinds = cut(tiles.groupBy("key", "ux", "uy").agg(F.count(F.lit(1)).alias("times"), F.min("bytes").alias("bytes")))
    meeting = cut(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
    unequal = kinds.join(meeting, "key")
    few = unequal.filter(F.col("members") <= group).select("key", "ux", "uy", "bytes").repartition("key").sortWithinPartitions("key")
    by_sorting = few.mapInArrow(_sorted_groups, _RANGES).toDF("key", "ux", "uy", "ranges")
    strings = unequal.filter(F.col("members") > group).select("key", "ux", "uy", "bytes").mapInArrow(_all_strings, "key bigint, ux bigint, uy bigint, start int, sx bigint, sy bigint")
    strings = cut(strings)
    twice = strings.groupBy("key", "sx", "sy").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "sx", "sy")
    by_count = strings.join(twice, ["key", "sx", "sy"]).groupBy("key", "ux", "uy").agg(F.flatten(F.array_sort(F.collect_list(F.array("start", "start")))).alias("ranges"))
    partial = cut(by_sorting.union(by_count))
    whole = kinds.filter("times > 1").select("key", "ux", "uy", F.array(F.lit(0), F.length("bytes") - LENGTH).alias("ranges"))
    repeated = whole.union(partial.join(whole, ["key", "ux", "uy"], "left_anti"))
    found = tiles.select("gram", "fx", "fy", "start", "key", "ux", "uy").join(repeated, ["key", "ux", "uy"])
    return found.select("gram", "fx", "fy", F.expr("transform(ranges, r -> r + start)").alias("ranges"))


def repeated_spans(docs: DataFrame, row: str = "row", text: str = "text", group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """((row, n_bytes, copies), (row, spans)): spans, as array<struct<start, stop>>, of texts without equal ones."""
    docs = docs.select(F.col(row).alias("row"), F.col(text).alias("text"))
    rows = cut(_fragment_rows(docs))
    texts = rows.select("row", "n_bytes", "tx", "ty").distinct()
    equal = texts.groupBy("tx", "ty").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies"))
    known = cut(texts.join(equal, ["tx", "ty"]).select("row", "rep", "n_bytes", "copies"))
    alone = known.filter("row = rep").select("row")
    fragments = rows.filter("gram IS NOT NULL").drop("n_bytes", "tx", "ty")
    # Written first, so that the join shuffles both sides and a k-gram that very many texts hold can be split.
    shared = cut(fragments.groupBy("gram").agg(F.sum(F.size("firsts")).alias("n")).filter("n > 1").select("gram"))
    fragments = cut(cut(fragments.join(shared, "gram")).join(alone, "row"))
    kinds = cut(
        fragments.groupBy("gram", "fx", "fy").agg(
            F.sum(F.size("firsts")).alias("times"), F.min("offset").alias("offset"), F.min("width").alias("width"), F.min_by(F.col("firsts")[0], "row").alias("first"), F.min("row").alias("row")
        )
    )
    meeting = cut(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
    unequal = kinds.join(meeting, "gram")
    wanted = unequal.groupBy("row").agg(F.collect_list(F.struct("gram", "fx", "fy", "first", "offset", "width")).alias("wanted"))
    pieces = cut(docs.join(wanted, "row").select("text", "wanted").mapInArrow(_cut_out, _PIECES).join(meeting, "gram"))
    few = pieces.filter(F.col("members") <= group).select("gram", "fx", "fy", "bytes").repartition("gram").sortWithinPartitions("gram")
    many = pieces.filter(F.col("members") > group).select("gram", "fx", "fy", "offset", "bytes")
    partial = cut(few.mapInArrow(_sorted_groups, _RANGES).union(_crowded_ranges(many, group)))
    whole = kinds.filter("times > 1").select("gram", "fx", "fy", F.array(F.lit(0), "width").alias("ranges"))
    repeated = cut(whole.union(partial.join(whole, ["gram", "fx", "fy"], "left_anti")))
    places = fragments.join(repeated, ["gram", "fx", "fy"]).select("row", F.explode("firsts").alias("first"), "ranges")
    of_text = places.select("row", F.expr(f"transform(sequence(0, cast(size(ranges) / 2 as int) - 1), k -> struct(first + ranges[2 * k] as start, first + ranges[2 * k + 1] + {LENGTH} as stop))").alias("spans"))
    spans = of_text.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return known.select("row", "n_bytes", "copies"), spans


def remove_spans(b: bytes, spans: list[dict]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs, what is left)."""
    removed = runs = at = 0
    kept = []
    for s in spans:
        if s["stop"] <= at:
            continue
        if s["start"] > at or not runs:
            kept.append(b[at : s["start"]])
            runs += 1
        removed += s["stop"] - max(s["start"], at)
        at = s["stop"]
    kept.append(b[at:])
    return removed, runs, b"".join(kept)


def remove_repeated(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and ``kept`` (binary), the bytes that no repeated string covers."""
    numbered = cut(docs.select("doc_id", text).withColumn("row", F.monotonically_increasing_id())) if _repeats_ids(docs) else docs.select("doc_id", text, F.col("doc_id").alias("row"))
    known, spans = repeated_spans(numbered, text=text)
    joined = numbered.join(known, "row").join(spans, "row", "left").select("doc_id", F.col(text).alias("text"), "copies", "spans")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for t, copies, found in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                b = (t.as_py() or "").encode()
                all_gone = copies > 1 and len(b) >= LENGTH
                out.append((len(b), *((len(b), 1, b"") if all_gone else remove_spans(b, found or []))))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(made, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def _repeats_ids(docs: DataFrame) -> bool:
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL")
    return bool(ids.limit(1).collect())


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

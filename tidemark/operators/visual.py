"""Frames of pictures by their perceptual hash: hashing, retrieval with a near miss allowed, and steady runs of matches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.operators.folds import fold
from tidemark.operators.groups import each_group
from tidemark.operators.matching import FLIPS, PARTS
from tidemark.session import once, ship_package

#: Side of a picture, frequencies kept on each axis, and the least variance that tells anything (fixed values).
SIDE, KEPT, LEAST_VARIANCE = 32, 8, 36.0
#: Time between frames, rows of a bucket and candidates of a frame beyond which nothing is decided, bits that may
#: differ, and matches of a run (fixed values).
STEP_MS, MOST_IN_BUCKET, MOST_CANDIDATES, MOST_BITS, LEAST_RUN = 250, 4_096, 4_096, 10, 8
#: A rival is this many bits behind at most, and more than this many steps away (fixed values).
RIVAL_BITS, RIVAL_STEPS = 2, 4
#: Source frames whose questions, 548 for each, a task answers.
FRAMES_EACH = 1_000
#: Target frames of a key that a task holds at once, source frames and pairs that it looks at together.
CELL_FRAMES, ASKED_EACH, PAIRS_EACH = 1 << 16, 1 << 12, 1 << 18
#: Bits of a quarter.
WIDTH = 64 // PARTS
#: Limits of a run's slope, steps between its matches on either side, and steps off its line (fixed values).
LEAST_SLOPE, MOST_SLOPE, SOURCE_STEPS, TARGET_STEPS, OFF_STEPS = 0.8, 1.25, 3, 4, 1.5


def _cosines() -> list[list[float]]:
    return [[math.cos((2 * x + 1) * u * math.pi / (2 * SIDE)) for x in range(SIDE)] for u in range(KEPT)]


def dct_hash(pixels: Column) -> Column:
    """64-bit hash of SIDE x SIDE grey values: which of the low frequencies, but the constant, are above their median;
    null where the picture varies too little to tell anything."""
    values = F.transform(pixels, lambda x: x.cast("double"))
    table = F.array(*[F.array(*map(F.lit, row)) for row in _cosines()])

    def summed(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def hashed(p: Column) -> Column:
        mean = summed(p) / (SIDE * SIDE)
        variance = once(mean, lambda m: summed(F.transform(p, lambda x: (x - m) * (x - m))) / (SIDE * SIDE))
        lines = F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda y: once(F.slice(p, y * SIDE + 1, SIDE), lambda r: F.transform(table, lambda c: summed(F.zip_with(r, c, lambda a, b: a * b)))))

        def bits(x: Column) -> Column:
            grid = F.flatten(F.transform(table, lambda c: F.transform(F.sequence(F.lit(0), F.lit(KEPT - 1)), lambda u: summed(F.zip_with(x, c, lambda line, b: F.get(line, u) * b)))))

            def above(g: Column) -> Column:
                middle = F.get(F.array_sort(F.slice(g, 2, KEPT * KEPT - 1)), F.lit(KEPT * KEPT // 2 - 1))
                return once(middle, lambda m: F.aggregate(F.transform(g, lambda v, k: F.when((k > 0) & (v > m), F.call_function("shiftleft", F.lit(1).cast("bigint"), k)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b)))

            return once(grid, above)

        return F.when(variance >= LEAST_VARIANCE, once(lines, bits))

    return once(values, hashed)


def turned(width: int) -> list[int]:
    """What ``width`` bits may be turned by: none of them, one, and so on up to FLIPS."""
    return [sum(1 << b for b in c) for n in range(FLIPS + 1) for c in combinations(range(width), n)]


def answers(part: int, cell: int, bits: int, asked: tuple[np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(at_ms, n, full, distance, least and most target_ms) of source frames, from the target frames whose quarter
    ``part`` begins with the ``bits`` of ``cell``.

    One row tells how many candidates a frame first meets in this quarter, or that it asks a bucket of more than
    ``most`` rows; a row for each distance up to MOST_BITS tells where such candidates are (no distance: -1).
    """

    def different(at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        value = (hashes >> np.uint64(part * WIDTH) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
        order = np.lexsort((at, hashes, value))
        at, hashes, value = at[order], hashes[order], value[order]
        new = np.append(True, (at[1:] != at[:-1]) | (hashes[1:] != hashes[:-1]))[: len(at)]
        return at[new], hashes[new], value[new]

    rows = np.bincount((held[1] >> np.uint64(part * WIDTH) & np.uint64((1 << WIDTH) - 1)).astype(np.int64), minlength=1 << WIDTH)
    t, y, v = different(*held)
    size = np.bincount(v, minlength=1 << WIDTH)
    begin = np.cumsum(size) - size
    at, x, value = different(*asked)
    beyond = (value >> (WIDTH - bits)) ^ cell
    for high in np.unique(beyond):
        flips = np.array([m for m in turned(WIDTH) if m >> (WIDTH - bits) == high], np.int64)
        own = np.flatnonzero(beyond == high)
        for k in range(0, len(own), ASKED_EACH):
            mine = own[k : k + ASKED_EACH]
            bucket = value[mine][:, None] ^ flips
            full = (rows[bucket] > most).any(axis=1)
            counts = np.where(full[:, None], 0, size[bucket])
            total = np.cumsum(counts.sum(axis=1))
            n = np.zeros(len(mine), np.int64)
            a = 0
            while a < len(mine):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS_EACH, "right")))
                some = counts[a:b].ravel()
                hit = np.flatnonzero(some)
                some = some[hit]
                asking = np.repeat(a + hit // len(flips), some)
                place = np.arange(len(asking)) + np.repeat(begin[bucket[a:b].ravel()[hit]] - (np.cumsum(some) - some), some)
                apart = x[mine[asking]] ^ y[place]
                first = np.ones(len(apart), bool)  # those that an earlier quarter shows are counted there
                for j in range(part):
                    first &= np.bitwise_count(apart >> np.uint64(j * WIDTH) & np.uint64((1 << WIDTH) - 1)) > FLIPS
                n += np.bincount(asking[first], minlength=len(mine))
                distance = np.bitwise_count(apart).astype(np.int64)
                near = np.flatnonzero(first & (distance <= MOST_BITS))
                if len(near):
                    key = asking[near] * (MOST_BITS + 1) + distance[near]
                    order = np.argsort(key, kind="stable")
                    key, there = key[order], t[place[near[order]]]
                    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                    who, none = at[mine[key[starts] // (MOST_BITS + 1)]], np.zeros(len(starts), np.int64)
                    yield who, none, none > 0, key[starts] % (MOST_BITS + 1), np.minimum.reduceat(there, starts), np.maximum.reduceat(there, starts)
                a = b
            told = np.flatnonzero((n > 0) | full)
            none = np.zeros(len(told), np.int64)
            yield at[mine[told]], n[told], full[told], none - 1, none, none


def frame_matches(source: DataFrame, target: DataFrame, by: list[str], most_in_bucket: int = MOST_IN_BUCKET, most_candidates: int = MOST_CANDIDATES) -> DataFrame:
    """(by, source_ms, target_ms, distance, ambiguous): the target frame nearest to each source frame.

    Frames are (by, at_ms, hash); those without a hash say nothing.  Hashes that differ in up to MOST_BITS bits share
    a quarter in which at most two differ, so a source frame asks for every such quarter.  A frame that asks a bucket
    with too many rows, or finds too many candidates, is ambiguous and has no match; so is one that has a rival, a
    candidate hardly further off at quite another time.

    Frames are dealt by key and quarter, and by the first bits of a quarter as far as a key's frames ask for it.  The
    questions, 548 for a frame, and the candidates are made where they are answered and never written; of a frame's
    candidates their number is handed on and, for each distance, their least and greatest time.
    """
    ship_package(source.sparkSession)
    known = F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, "at_ms", "hash"]))
    source, target = (side.filter(known).select(*by, F.col("at_ms").cast("bigint").alias("at_ms"), F.col("hash").cast("bigint").alias("hash")) for side in (source, target))
    tasks = max(1, -(-source.count() // FRAMES_EACH))
    crowd = target.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bits = min(WIDTH, max(0, -(-crowd // CELL_FRAMES) - 1).bit_length())

    def dealt(frames: DataFrame, side: int, flips: list[int]) -> DataFrame:
        begins = F.array(*[F.shiftrightunsigned("hash", (k + 1) * WIDTH - bits).bitwiseAND((1 << bits) - 1) if bits else F.lit(0).cast("bigint") for k in range(PARTS)])
        rows = frames.select("*", F.posexplode(begins).alias("part", "begin"), F.lit(side).alias("side"))
        return rows.select(*by, "part", F.explode(F.transform(F.array(*[F.lit(m).cast("bigint") for m in flips]), lambda m: F.col("begin").bitwiseXOR(m))).alias("cell"), "side", "at_ms", "hash")

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    made = StructType.fromDDL(", ".join([*(f"`{c}` {kinds[c]}" for c in by), "source_ms bigint, n bigint, full boolean, distance bigint, low bigint, high bigint"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(made)
        for group in each_group(batches, [*by, "part", "cell"]):
            asks, hashes = group["side"] == 1, group["hash"].astype(np.int64).view(np.uint64)
            if asks.all() or not asks.any():
                continue
            sides = [(group["at_ms"][s].astype(np.int64), hashes[s]) for s in (asks, ~asks)]
            for found in answers(int(group["part"][0]), int(group["cell"][0]), bits, *sides, most_in_bucket):
                if len(found[0]):
                    keys = [pa.array([group[c][0]] * len(found[0]), types.field(c).type) for c in by]
                    yield pa.RecordBatch.from_arrays([*keys, *(pa.array(x, types.field(len(by) + k).type) for k, x in enumerate(found))], schema=types)

    keys = [*by, "part", "cell"]
    both = dealt(target, 0, [0]).unionByName(dealt(source, 1, turned(bits)))
    told = both.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(run, made)
    near = F.col("distance") >= 0
    found = told.groupBy(*by, "source_ms").agg(
        (F.bool_or("full") | (F.sum("n") > most_candidates)).alias("many"), F.min(F.when(near, F.struct("distance", "low"))).alias("best"),
        F.collect_list(F.when(near, F.struct("distance", "low", "high"))).alias("seen"),
    )
    away = RIVAL_STEPS * STEP_MS
    rival = F.exists("seen", lambda c: (c["distance"] <= F.col("best.distance") + RIVAL_BITS) & ((F.col("best.low") - c["low"] > away) | (c["high"] - F.col("best.low") > away)))
    found = found.filter(F.col("many") | F.col("best").isNotNull()).withColumn("ambiguous", F.col("many") | rival)
    clear = ~F.col("ambiguous")
    return found.select(*by, "source_ms", F.when(clear, F.col("best.low")).alias("target_ms"), F.when(clear, F.col("best.distance").cast("int")).alias("distance"), "ambiguous")


def steady_runs(anchors: DataFrame, by: list[str]) -> DataFrame:
    """(by, run, source_start, source_end, target_start, target_end, anchors, residual_ms): runs of matches on a line.

    A run ends where the next match is too far on either side, does not advance, or, once the run is long enough,
    lies off the line from its first to its last match.  Runs that are too short, too steep or too flat, or that leave
    their line, are dropped.  The state of the fold is a run's first and last match and its length.
    """

    def step(state: tuple | None, row: dict) -> tuple[tuple, list[tuple]]:
        s, t = row["source_ms"], row["target_ms"]
        if state is None:
            return (0, 1, s, t, s, t), [(0, s, t)]
        run, n, s0, t0, s1, t1 = state
        ds, dt = s - s1, t - t1
        split = ds > STEP_MS * SOURCE_STEPS or dt > STEP_MS * TARGET_STEPS or ds == 0 or dt == 0
        if not split and n >= LEAST_RUN:
            split = abs(t - (t0 + (s - s0) * ((t1 - t0) / (s1 - s0)))) > STEP_MS * OFF_STEPS
        state = (run + 1, 1, s, t, s, t) if split else (run, n + 1, s0, t0, s, t)
        return state, [(state[0], s, t)]

    rows = fold(anchors.select(*by, "source_ms", "target_ms"), by, ["source_ms", "target_ms"], step, "run bigint, source_ms bigint, target_ms bigint")
    w = W.partitionBy(*by, "run")
    first, last = F.min(F.struct("source_ms", "target_ms")).over(w), F.max(F.struct("source_ms", "target_ms")).over(w)
    rows = rows.withColumns({"a": first, "b": last}).withColumn("slope", (F.col("b.target_ms") - F.col("a.target_ms")) / F.greatest(F.col("b.source_ms") - F.col("a.source_ms"), F.lit(1)))
    off = F.abs(F.col("target_ms") - F.col("a.target_ms") - (F.col("source_ms") - F.col("a.source_ms")) * F.col("slope"))
    runs = rows.groupBy(*by, "run").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("slope").alias("slope"), F.count(F.lit(1)).alias("anchors"), F.max(off).alias("residual_ms"))
    kept = runs.filter((F.col("anchors") >= LEAST_RUN) & F.col("slope").between(LEAST_SLOPE, MOST_SLOPE) & (F.col("residual_ms") <= STEP_MS * OFF_STEPS))
    return kept.select(*by, "run", F.col("a.source_ms").alias("source_start"), F.col("b.source_ms").alias("source_end"), F.col("a.target_ms").alias("target_start"), F.col("b.target_ms").alias("target_end"), "anchors", "residual_ms")

"""Matching of feature vectors, hashes and sequences."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.groups import each_table
from tidemark.session import cut, once, ship_package


def median_bits(vector: Column) -> Column:
    """64-bit perceptual hash: bit k is set where component k exceeds the median (the mean of the two middle ones)."""
    v = F.transform(vector, lambda x: x.cast("double"))
    ordered = F.array_sort(v)

    def bits(s: Column) -> Column:
        middle = (F.get(s["o"], 31) + F.get(s["o"], 32)) / 2
        return once(middle, lambda m: F.transform(s["v"], lambda x, k: F.when(x > m, F.call_function("shiftleft", F.lit(1).cast("bigint"), k)).otherwise(F.lit(0).cast("bigint"))))

    return F.aggregate(once(F.struct(v.alias("v"), ordered.alias("o")), bits), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


#: Equal parts of a 64-bit hash, and bits that may differ in the part in which two hashes meet.
PARTS, FLIPS = 4, 2


def hamming_pairs(rows: DataFrame, key: str, bits: str, most: int) -> DataFrame:
    """Pairs whose hashes differ in at most ``most`` bits, which is less than PARTS * (FLIPS + 1).

    Two such hashes have a part in which at most FLIPS bits differ.  One side is listed under its parts, the other
    under its parts with up to FLIPS bits turned, so they meet by equality; a pair counts in the first part it meets in.
    """
    if most >= PARTS * (FLIPS + 1):
        raise ValueError(f"{most} bits may be spread so that no part has {FLIPS} or fewer")
    width = 64 // PARTS
    mask = (1 << width) - 1
    turned = [0] + [sum(1 << b for b in c) for n in range(1, FLIPS + 1) for c in combinations(range(width), n)]

    def parts(b: Column) -> Column:
        return F.array(*[F.shiftrightunsigned(b, k * width).bitwiseAND(mask) for k in range(PARTS)])

    held = rows.select(F.col(key).alias("b"), F.col(bits).alias("y"), F.posexplode(parts(F.col(bits))).alias("part", "value"))
    asked = rows.select(F.col(key).alias("a"), F.col(bits).alias("x"), F.posexplode(parts(F.col(bits))).alias("part", "v"))
    asked = asked.select("a", "x", "part", F.explode(F.transform(F.array(*[F.lit(t).cast("bigint") for t in turned]), lambda t: F.col("v").bitwiseXOR(t))).alias("value"))
    met = asked.join(held, ["part", "value"]).filter("a < b").withColumn("apart", F.col("x").bitwiseXOR(F.col("y")))
    first = F.lit(True)
    for k in range(PARTS - 1):
        first = first & ((F.col("part") <= k) | (F.bit_count(F.shiftrightunsigned("apart", k * width).bitwiseAND(mask)) > FLIPS))
    return met.filter(first).select("a", "b", F.bit_count("apart").cast("int").alias("distance")).filter(F.col("distance") <= most)


#: Vectors of a block, rows of it and candidates that are compared at a time, and pairs that a task compares on average.
BLOCK, SLAB, CANDIDATES, PAIRS_EACH = 4_096, 256, 50_000, 50_000_000


def fingerprint_pairs(rows: DataFrame, key: str, vector: str, step: float, tolerance: float) -> DataFrame:
    """Pairs with the same four quantised leading components and a root-mean-square distance within the tolerance.

    Vectors of a bucket are dealt to blocks by their keys' hash, and each two blocks are a group of their own, so a
    task holds two blocks however large a bucket is; the number of tasks grows with the pairs to compare.  A product of
    the blocks passes over pairs that are surely too far; of the others the distance is summed component by component.
    Vectors that are null, shorter than four or hold null or non-finite components meet nothing.
    """
    finite = F.forall(vector, lambda x: F.abs(x.cast("double")) < float("inf"))
    by = [*(f"q{k}" for k in range(4)), "size"]
    keyed = rows.filter(F.col(key).isNotNull() & (F.size(vector) >= 4) & finite).select(F.col(key).alias("key"), F.col(vector).alias("vector"), *[F.floor(F.get(vector, k).cast("double") / step).alias(f"q{k}") for k in range(4)], F.size(vector).alias("size"))
    counts = cut(keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    pairs = counts.agg(F.coalesce(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]
    placed = keyed.join(counts.drop("n"), by).withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", "vector", *by, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block")
    by = [*by, "lo", "hi"]
    within = (tolerance + 1e-6) ** 2
    kind = rows.schema[key].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in each_table(batches, by):
            vectors = group.column("vector").combine_chunks()
            x = vectors.flatten().cast(pa.float64()).to_numpy().reshape(len(vectors), -1)
            keys, block = group.column("key").combine_chunks(), group.column("block").to_numpy()
            same, size = block[0] == block[-1] and group.column("lo")[0].as_py() == group.column("hi")[0].as_py(), x.shape[1]
            first = len(x) if same else int(np.searchsorted(block, block[0], "right"))
            lengths, flat = (x * x).sum(axis=1), np.ascontiguousarray(x.T)
            for at in range(0, first if same or first < len(x) else 0, SLAB):
                to, begin = min(at + SLAB, first), at if same else first
                apart = lengths[at:to, None] + lengths[begin:]
                near = apart - 2 * (x[at:to] @ x[begin:].T) <= within * size + 1e-9 * (1 + apart)
                i, j = np.nonzero(near)
                i, j = i + at, j + begin
                if same:
                    i, j = i[i < j], j[i < j]
                for k in range(0, len(i), CANDIDATES):
                    p, q = i[k : k + CANDIDATES], j[k : k + CANDIDATES]
                    total = np.zeros(len(p))
                    for component in flat:
                        total += (component[p] - component[q]) ** 2
                    a, b = keys.take(pa.array(p)), keys.take(pa.array(q))
                    yield pa.RecordBatch.from_arrays([a, b, pa.array(np.sqrt(total / size))], ["x", "y", "distance"])

    ship_package(rows.sparkSession)
    dealt = met.repartition(max(1, int(-(-pairs // PAIRS_EACH))), *by).sortWithinPartitions(*by, "block", "key")
    found = dealt.mapInArrow(compare, f"x {kind}, y {kind}, distance double").filter("x <> y")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("distance", 6).alias("distance")).filter(F.col("distance") <= tolerance)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_cost(a: Column, b: Column) -> Column:
    """1000 * (1 - cosine), rounded; 1000 where a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    cost = F.floor(F.least(F.greatest(1 - dot(a, b) / norms, F.lit(0.0)), F.lit(2.0)) * 1000 + 0.5)
    return F.when(norms <= 2.220446049250313e-16, F.lit(1000).cast("long")).otherwise(cost)


def rms_distance(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(total / F.size(a))


def increasing_path(rows: DataFrame, by: str, source: str, target: str) -> DataFrame:
    """The longest chain of anchors that increases strictly on both axes, per key; one key's anchors fit in a task."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([source, target], ascending=[True, False], kind="stable")
        x = frame[target].to_numpy()
        tails: list[int] = []
        ends: list = []
        back = np.full(len(x), -1)
        for k, v in enumerate(x.tolist()):
            at = bisect_left(ends, v)
            back[k] = tails[at - 1] if at else -1
            tails[at : at + 1], ends[at : at + 1] = [k], [v]
        chain, k = [], tails[-1] if tails else -1
        while k >= 0:
            chain.append(k)
            k = back[k]
        out = frame.iloc[chain[::-1]][[by, source, target]].copy()
        out["step"] = np.arange(len(out))
        return out

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(by, source, target).groupBy(by).applyInPandas(solve, f"{by} {kind[by]}, {source} {kind[source]}, {target} {kind[target]}, step bigint")

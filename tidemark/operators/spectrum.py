"""Spectra of sampled signals, their peaks, and landmarks: pairs of peaks a short time apart.

Signals come as chunks of samples of any size.  In batches, windows, peaks and pairs are Spark's own expressions and
windows over a signal's frames; only the Fourier transform of whole batches of frames is NumPy's.  The same landmarks
come from ``streaming.landmarks`` as the chunks arrive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.lookup import bottom_k
from tidemark.session import ship_package

#: Bands of a spectrum, their lowest and highest frequency, the share of the rate that may be used, and the largest
#: sample (fixed values).
BANDS, LOWEST_HZ, HIGHEST_HZ, USABLE, LOUDEST = 48, 80.0, 3_600.0, 0.45, 32_767.0
#: From this rate on every other sample is taken (fixed value).
HALVED_FROM = 8_000
#: Steps of the time between two peaks in a hash, and the largest step (fixed values).
STEP_MS, MOST_STEPS = 50, 255


@dataclass(frozen=True)
class Sound:
    rate: int = 16_000
    window_ms: int = 40
    hop_ms: int = 25
    silence: float = 0.008
    above_mean: float = 2.25
    peaks: int = 4
    partners: int = 5
    least_ms: int = 75
    most_ms: int = 1_000
    per_family: int = 48
    start_ms: int = 0

    @property
    def window(self) -> int:
        return self.rate * self.window_ms // 1000

    @property
    def hop(self) -> int:
        return self.rate * self.hop_ms // 1000

    @property
    def stride(self) -> int:
        return 2 if self.rate >= HALVED_FROM else 1

    @property
    def length(self) -> int:
        """Points of the Fourier transform."""
        return 1 << (max(8, -(-self.window // self.stride)) - 1).bit_length()

    def bins(self) -> list[int]:
        """The transform's bin of every band; bands are evenly wide in the logarithm of the frequency."""
        rate = self.rate / self.stride
        top = min(rate * USABLE, HIGHEST_HZ)
        return [min(math.floor(LOWEST_HZ * (top / LOWEST_HZ) ** (b / (BANDS - 1)) * self.length / rate + 0.5), self.length // 2) for b in range(BANDS)]

    def time_ms(self, frame):
        """The middle of a frame."""
        return self.start_ms + (frame * self.hop + self.window // 2) * 1000 // self.rate


def spectra(samples: np.ndarray, sound: Sound) -> tuple[np.ndarray, np.ndarray]:
    """Bands and loudness of frames (frames, samples)."""
    x = samples.astype(float) / LOUDEST
    loud = np.sqrt((x * x).mean(axis=1))
    x = x[:, :: sound.stride]
    n = x.shape[1]
    shape = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / max(n - 1, 1))
    return np.abs(np.fft.rfft(x * shape, sound.length, axis=1))[:, sound.bins()], loud


def frames(chunks: DataFrame, media: str, sound: Sound) -> DataFrame:
    """(media, frame, samples): windows over signals whose chunks are (media, seq, samples).

    A chunk goes to the frames that it touches as the piece they need of it; frames without all their samples, at a
    signal's end, are left out.
    """
    w = W.partitionBy(media).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    size = F.size("samples")
    # A sum over rows of two numbers: the samples join it again where they are.
    at = chunks.filter(size > 0).withColumn("_a", F.coalesce(F.sum(size).over(w), F.lit(0)))
    first = F.greatest(F.lit(0), F.floor((F.col("_a") - sound.window) / sound.hop) + 1)
    last = F.floor((F.col("_a") + size - 1) / sound.hop)
    touched = at.withColumn("frame", F.explode(F.sequence(first, last)))
    start = F.col("frame") * sound.hop
    begin = F.greatest(start - F.col("_a"), F.lit(0))
    stop = F.least(start + sound.window - F.col("_a"), size)
    piece = F.slice("samples", (begin + 1).cast("int"), (stop - begin).cast("int"))
    pieces = touched.filter(stop > begin).groupBy(media, "frame").agg(F.array_sort(F.collect_list(F.struct(F.col("_a").alias("a"), piece.alias("x")))).alias("_p"))
    whole = pieces.select(media, "frame", F.flatten(F.transform("_p", lambda p: p["x"])).alias("samples"))
    return whole.filter(F.size("samples") == sound.window)


def spectral_frames(framed: DataFrame, media: str, sound: Sound) -> DataFrame:
    """(media, frame, time_ms, bands, loud) of frames with samples."""
    ship_package(framed.sparkSession)
    kind = framed.schema[media].dataType.simpleString()

    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples = np.stack(batch.column(2).to_pylist()) if batch.num_rows else np.zeros((0, sound.window))
            bands, loud = spectra(samples, sound)
            time = pa.array(sound.time_ms(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), time, pa.array(bands.tolist(), pa.list_(pa.float64())), pa.array(loud)], [media, "frame", "time_ms", "bands", "loud"])

    return framed.select(media, F.col("frame").cast("long"), "samples").mapInArrow(transformed, f"`{media}` {kind}, frame bigint, time_ms bigint, bands array<double>, loud double")


def peaks(spectral: DataFrame, media: str, sound: Sound) -> DataFrame:
    """(media, frame, time_ms, peaks): bands louder than their neighbours in frequency and time and than the frame's mean.

    Against the band below and the frame behind a peak must be louder, against the band above and the frame before it
    may be equal.  The loudest come first, of equals the lower band; frames that are silent have none.
    """
    w = W.partitionBy(media).orderBy("frame")
    silent = F.array_repeat(F.lit(0.0), BANDS)
    rows = spectral.withColumns({"_before": F.coalesce(F.lag("bands").over(w), silent), "_behind": F.coalesce(F.lead("bands").over(w), silent)})
    mean = F.aggregate("bands", F.lit(0.0), lambda s, x: s + x) / BANDS

    def is_peak(b: Column) -> Column:
        x = F.get("bands", b)
        return (x > F.get("bands", b - 1)) & (x >= F.get("bands", b + 1)) & (x >= F.get("_before", b)) & (x > F.get("_behind", b)) & (x >= F.col("_mean") * sound.above_mean)

    found = F.filter(F.sequence(F.lit(1), F.lit(BANDS - 2)), is_peak)
    ranked = F.array_sort(F.transform(found, lambda b: F.struct((-F.get("bands", b)).alias("m"), b.alias("band"))))
    top = F.transform(F.slice(ranked, 1, sound.peaks), lambda p: F.struct(p["band"].alias("band"), (-p["m"]).alias("magnitude")))
    return rows.withColumn("_mean", mean).filter(F.col("loud") >= sound.silence).select(media, "frame", "time_ms", top.alias("peaks")).filter(F.size("peaks") > 0)


def landmark_hash(first: Column, second: Column, delta_ms: Column) -> Column:
    step = F.least(F.lit(MOST_STEPS), F.floor((delta_ms + STEP_MS // 2) / STEP_MS))
    return F.shiftleft(first.cast("long"), 16).bitwiseOR(F.shiftleft(second.cast("long"), 8)).bitwiseOR(step)


def landmarks(peaked: DataFrame, media: str, sound: Sound) -> DataFrame:
    """(media, time_ms, hash, strength, place): every peak with the next ``partners`` peaks inside the time range.

    ``place`` is the order in which they are complete: the partner's frame, the peak's, and their ranks.  A window over time holds the peaks in reach,
    so the rows of a signal stay as many as its frames until the pairs are made.
    """
    near = W.partitionBy(media).orderBy("time_ms").rangeBetween(sound.least_ms, sound.most_ms)
    reached = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("time_ms", "frame", "peaks")).over(near)), lambda r: F.transform(r["peaks"], lambda p: F.struct(r["time_ms"].alias("t"), r["frame"].alias("frame"), p["band"].alias("band"), p["magnitude"].alias("magnitude")))))
    rows = peaked.withColumn("_next", F.slice(reached, 1, sound.partners))
    rows = rows.select(media, "frame", "time_ms", "_next", F.posexplode("peaks").alias("_i", "_p")).select(media, "frame", "time_ms", "_i", "_p", F.posexplode("_next").alias("_j", "_n"))
    strength = F.floor(F.log(F.least("_p.magnitude", "_n.magnitude") + 1) * 1000 + 0.5).cast("long")
    place = F.struct(F.col("_n.frame").alias("until"), "frame", F.col("_i").alias("peak"), F.col("_j").alias("partner"))
    return rows.select(media, "time_ms", landmark_hash(F.col("_p.band"), F.col("_n.band"), F.col("_n.t") - F.col("time_ms")).alias("hash"), strength.alias("strength"), place.alias("place"))


def priority(family: np.ndarray, ordinal: np.ndarray) -> np.ndarray:
    """A place in line, as a signed number, that depends on a landmark's family and its number in it only."""
    x, n = family.astype(np.uint64), ordinal.astype(np.uint64)
    x = (x ^ (n << np.uint64(17) | n >> np.uint64(47))) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31)) ^ np.uint64(1 << 63)).view(np.int64)


def numbered_landmarks(found: DataFrame, media: str) -> DataFrame:
    """(media, time_ms, hash, strength, family, ordinal): how many of its family were complete before each landmark."""
    rows = found.withColumn("family", F.shiftright("hash", 8))
    return rows.withColumn("ordinal", (F.row_number().over(W.partitionBy(media, "family").orderBy("place")) - 1).cast("long")).drop("place")


def bounded_index(numbered: DataFrame, media: str, sound: Sound) -> DataFrame:
    """Of every family the ``per_family`` landmarks that are first in line, whatever its length."""
    ship_package(numbered.sparkSession)
    names = [*numbered.columns, "priority"]
    at = [numbered.columns.index(c) for c in ("family", "ordinal")]

    def lined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            family, ordinal = (batch.column(k).to_numpy(zero_copy_only=False) for k in at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(priority(family, ordinal))], names)

    rows = numbered.mapInArrow(lined_up, numbered.select("*", F.lit(0).cast("long").alias("priority")).schema)
    return bottom_k(rows, [media, "family"], ["priority", "ordinal"], sound.per_family)


def observations(pairs: DataFrame, indexes: DataFrame, media: str, most: int = 64, each: int = 8, most_sources: int = 5_000) -> DataFrame:
    """(pair_id, source_index, target_index, source_ms, target_ms): landmarks of two signals with one family and about
    the same time between their peaks.

    ``pairs`` is (pair_id, source, target), two signals of ``indexes`` each.  Families with more than ``most``
    landmarks on either side tell nothing and are dropped by their counts before anything is joined.  Of a signal with
    many landmarks every nth is looked up, and of a target's family about ``each`` are met.
    """
    order = ["time_ms", "hash", F.desc("strength")]
    per_media, per_family = W.partitionBy(media).orderBy(*order), W.partitionBy(media, "family").orderBy(*order)
    rows = indexes.withColumns({"i": F.row_number().over(per_media) - 1, "f": F.row_number().over(per_family) - 1, "of": F.count(F.lit(1)).over(W.partitionBy(media, "family")), "n": F.count(F.lit(1)).over(W.partitionBy(media))})
    rows = rows.filter(F.col("of") <= most).withColumn("step", F.col("hash").bitwiseAND(MOST_STEPS))
    left = rows.filter(F.col("i") % F.ceil(F.col("n") / most_sources) == 0).select(F.col(media).alias("source"), "family", F.col("i").alias("source_index"), F.col("time_ms").alias("source_ms"), F.col("step").alias("a"))
    right = rows.filter(F.col("f") % F.ceil(F.col("of") / each) == 0).select(F.col(media).alias("target"), "family", F.col("i").alias("target_index"), F.col("time_ms").alias("target_ms"), F.col("step").alias("b"))
    met = pairs.select("pair_id", "source", "target").join(left, "source").join(right, ["target", "family"]).filter(F.abs(F.col("a") - F.col("b")) <= 1)
    return met.select("pair_id", "source_index", "target_index", "source_ms", "target_ms")

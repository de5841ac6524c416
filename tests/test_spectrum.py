"""Landmarks in batches and as a stream, whatever the chunks, against a plain loop."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import spectrum as S
from tidemark.streaming.landmarks import landmark_stream

SOUND = S.Sound(rate=1000, above_mean=1.6)


def signal(seed, n):
    rng = random.Random(seed)
    tones = [(rng.uniform(80, 440), rng.uniform(0.5, 6)) for _ in range(6)]
    return [int(4000 * sum(math.sin(2 * math.pi * f * k / 1000) * math.sin(w * k / 100) for f, w in tones) + rng.uniform(-300, 300)) if 400 <= k % 2600 else 0 for k in range(n)]


SIGNALS = {1: signal(1, 6000), 2: signal(2, 3333), 3: signal(3, 39), 4: signal(1, 5000)}


def plain(x, s):
    """Landmarks by the book: direct Fourier sums, one frame after the other."""
    n = (len(x) - s.window) // s.hop + 1 if len(x) >= s.window else 0
    bins = s.bins()
    bands, loud = [], []
    for f in range(n):
        w = [v / 32767 for v in x[f * s.hop : f * s.hop + s.window]]
        loud.append(math.sqrt(sum(v * v for v in w) / len(w)))
        w = w[:: s.stride]
        w = [v * (0.5 - 0.5 * math.cos(2 * math.pi * k / (len(w) - 1))) for k, v in enumerate(w)]
        by = {b: abs(sum(v * complex(math.cos(2 * math.pi * b * k / s.length), -math.sin(2 * math.pi * b * k / s.length)) for k, v in enumerate(w))) for b in set(bins)}
        bands.append([by[b] for b in bins])
    peaks = []
    for f in range(n):
        m = bands[f]
        at = lambda g, b: bands[g][b] if 0 <= g < n else 0.0
        own = [b for b in range(1, 47) if m[b] > m[b - 1] and m[b] >= m[b + 1] and m[b] >= at(f - 1, b) and m[b] > at(f + 1, b) and m[b] >= sum(m) / 48 * s.above_mean]
        peaks.append(sorted(own, key=lambda b: (-m[b], b))[: s.peaks] if loud[f] >= s.silence else [])
    out = []
    for f in range(n):
        for p in peaks[f]:
            left = s.partners
            for g in range(f + 1, n):
                delta = s.time_ms(g) - s.time_ms(f)
                if s.least_ms <= delta <= s.most_ms:
                    for q in peaks[g][:left]:
                        out.append((s.time_ms(f), p << 16 | q << 8 | min(255, (delta + 25) // 50), math.floor(math.log(min(bands[f][p], bands[g][q]) + 1) * 1000 + 0.5)))
                    left -= len(peaks[g][:left])
    return sorted(out)


def chunked(size, rng=None):
    rows = []
    for media, x in SIGNALS.items():
        at, seq = 0, 0
        while at < len(x):
            n = size if rng is None else rng.randint(1, size)
            rows.append((media, seq, x[at : at + n], at + n >= len(x)))
            at, seq = at + n, seq + 1
    return rows


CHUNKS = "media int, seq int, samples array<int>, last boolean"


def batch(spark, rows):
    df = spark.createDataFrame(rows, CHUNKS).repartition(3)
    peaked = S.peaks(S.spectral_frames(S.frames(df, "media", SOUND), "media", SOUND), "media", SOUND)
    return S.numbered_landmarks(S.landmarks(peaked, "media", SOUND), "media")


@pytest.mark.parametrize("size", [1, 17, 640, 10_000])
def test_batches_of_any_chunks(spark, size):
    rows = chunked(size) if size > 1 else [(m, k, [v], k == 699) for m in (1, 3) for k, v in enumerate(SIGNALS[m][:700])]
    got = {}
    for r in batch(spark, rows).collect():
        got.setdefault(r["media"], []).append((r["time_ms"], r["hash"], r["strength"]))
    for media in {r[0] for r in rows}:
        whole = [v for r in sorted(r for r in rows if r[0] == media) for v in r[2]]
        assert sorted(got.get(media, [])) == plain(whole, SOUND)
    assert size == 1 or len(got[1]) > 100


def test_decimated_rates():
    s = S.Sound()
    assert (s.window, s.hop, s.stride, s.length) == (640, 400, 2, 512)
    x = np.random.default_rng(1).integers(-9000, 9000, (2, 640))
    bands, loud = S.spectra(x, s)
    w = x[1, ::2] / 32767 * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(320) / 319))
    for band in (0, 20, 47):
        b = s.bins()[band]
        assert np.isclose(bands[1, band], abs((w * np.exp(-2j * np.pi * b * np.arange(320) / 512)).sum()))
    assert np.isclose(loud[0], np.sqrt(((x[0] / 32767) ** 2).mean()))


def test_stream_of_any_chunks(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    want = sorted(tuple(r) for r in batch(spark, chunked(10_000)).select("media", "time_ms", "hash", "strength", "family", "ordinal").collect())
    for n, (size, rng) in enumerate([(700, None), (1500, random.Random(4))]):
        rows = chunked(size, rng)
        folder = tmp_path / f"in{n}"
        os.makedirs(folder)
        for k in range(0, max(r[1] for r in rows) + 1, 3):
            part = [r for r in rows if k <= r[1] < k + 3]
            spark.createDataFrame(part, CHUNKS).coalesce(1).write.mode("append").parquet(str(folder / f"part{k:04}"))
        stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(folder))
        name = f"landmarks{n}"
        query = landmark_stream(stream, "media", SOUND).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"check{n}")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
        assert sorted(tuple(r) for r in spark.table(name).collect()) == want


def test_bounded_families(spark):
    rows = [(1, f, o) for f in (5, 600) for o in range(200)] + [(2, 5, o) for o in range(10)]
    df = spark.createDataFrame(rows, "media int, family bigint, ordinal bigint").repartition(4)
    sound = S.Sound(per_family=48)
    got = {}
    for r in S.bounded_index(df, "media", sound).collect():
        got.setdefault((r["media"], r["family"]), set()).add(r["ordinal"])

    def line(family, ordinal):
        m = (1 << 64) - 1
        x = (family ^ ((ordinal << 17 | ordinal >> 47) & m)) + 0x9E3779B97F4A7C15 & m
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    assert got == {(m, f): set(sorted(range(n), key=lambda o: line(f, o))[:48]) for m, f, n in ((1, 5, 200), (1, 600, 200), (2, 5, 10))}
    assert "WindowGroupLimit" in S.bounded_index(df, "media", sound)._jdf.queryExecution().toString()


def test_observations_leave_out_common_families(spark):
    rows = [("a", 100 * k, k % 4 << 16 | 7 << 8 | k % 3, k) for k in range(40)] + [("b", 100 * k + 500, k % 4 << 16 | 7 << 8 | k % 3, k) for k in range(30)]
    rows += [("a", 50 * k, 9 << 16 | 9 << 8, 1) for k in range(70)] + [("b", 3, 9 << 16 | 9 << 8, 1)]
    index = spark.createDataFrame(rows, "media string, time_ms bigint, hash bigint, strength bigint").withColumn("family", F.shiftright("hash", 8))
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "b", "b")], "pair_id int, source string, target string")
    out = S.observations(pairs, index, "media").collect()
    order = {m: sorted([r for r in rows if r[0] == m], key=lambda r: (r[1], r[2], -r[3])) for m in "ab"}
    want = set()
    for pair, s, t in ((1, "a", "b"), (2, "b", "b")):
        for i, x in enumerate(order[s]):
            family = [(j, y) for j, y in enumerate(order[t]) if y[2] >> 8 == x[2] >> 8]
            if not family or sum(y[2] >> 8 == x[2] >> 8 for y in order[s]) > 64 or len(family) > 64:
                continue
            want |= {(pair, i, j, x[1], y[1]) for j, y in family[:: -(-len(family) // 8)] if abs((x[2] & 255) - (y[2] & 255)) <= 1}
    assert {tuple(r) for r in out} == want and len(out) == len(want) > 100


def test_frames_dealt_to_many_tasks_find_the_same(spark, monkeypatch):
    import random

    from tidemark.operators import visual

    rng = random.Random(4)
    frames = [(k % 3, k * 250, rng.getrandbits(63)) for k in range(60)]
    source = spark.createDataFrame(frames, "label int, at_ms bigint, hash bigint")
    target = spark.createDataFrame([(p, t + 5000, h ^ 5) for p, t, h in frames], "label int, at_ms bigint, hash bigint")
    found = []
    for each in (1_000, 7):
        monkeypatch.setattr(visual, "FRAMES_EACH", each)
        matches = visual.frame_matches(source, target, ["label"])
        found.append(sorted(map(tuple, matches.collect())))
    assert found[0] == found[1] and {(p, t) for p, t, *_ in found[0]} == {(p, t) for p, t, _ in frames} and all(r[2] == r[1] + 5000 for r in found[0])

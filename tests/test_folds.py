"""Folds against plain loops, perceptual hashes against direct sums, and runs of frame matches."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import folds, visual


def test_fold_keeps_order_and_keys(spark):
    rows = [(k % 5 if k % 7 else None, k) for k in range(2000)]
    df = spark.createDataFrame(rows, "k int, at int").repartition(7)
    add = lambda s, r: ((s or 0) + r["at"], [(r["at"], (s or 0) + r["at"])])
    out = folds.fold(df, ["k"], ["at"], add, "at int, total bigint", last=lambda s: [(-1, s)]).collect()
    want, sums = set(), {}
    for k, at in sorted(rows, key=lambda r: r[1]):
        sums[k] = sums.get(k, 0) + at
        want.add((k, at, sums[k]))
    assert {tuple(r) for r in out} == want | {(k, -1, s) for k, s in sums.items()}
    assert folds.fold(df.limit(0), ["k"], ["at"], add, "at int, total bigint", last=lambda s: [(-1, s)]).collect() == []


def cuts(rng, key, n):
    out, at = [], 0
    for _ in range(n):
        at += rng.choice([0, 300, 900, 1500, 2000, 2001, 5000])
        out.append((key, at, rng.randrange(1000, 9000), round(rng.random(), 3), rng.choice([None, at - rng.randrange(500)]), rng.choice([None, at + rng.randrange(500)])))
    return out


def test_merged_cuts_are_no_sessions(spark):
    rng = random.Random(1)
    rows = [c for key in range(12) for c in cuts(rng, key, rng.randint(1, 40))]
    rows += [(99, t, 1000, 0.5, None, None) for t in (0, 1500, 3000, 4500)]
    df = spark.createDataFrame(rows, "k int, at bigint, gap bigint, confidence double, a bigint, b bigint").repartition(4)
    got = {}
    for r in folds.merge_near(df, ["k"], "at", "gap", "confidence", "a", "b").collect():
        got.setdefault(r["k"], []).append(tuple(r)[1:])
    for key in {r[0] for r in rows}:
        want = []
        for _, at, gap, c, a, b in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2], r[3], r[4] if r[4] is not None else r[1], r[5] if r[5] is not None else r[1])):
            a, b = at if a is None else a, at if b is None else b
            if want and abs(at - want[-1][0]) <= 2000:
                p = want[-1]
                want[-1] = (p[0], p[1] + gap, min(p[2], c), min(p[3], a), max(p[4], b), p[5] + 1)
            else:
                want.append((at, gap, c, a, b, 1))
        assert sorted(got[key]) == sorted(want)
    # A session would be one: every cut is within two seconds of the one before.
    assert [x[0] for x in sorted(got[99])] == [0, 3000]


def test_held_offsets(spark):
    rng = random.Random(2)
    rows = []
    for key in range(8):
        offset = 0
        for k in range(rng.randint(1, 90)):
            offset += rng.choice([0] * 12 + [4000, -3000])
            rows.append((key, 500 * k, offset + rng.choice([0] * 6 + [90, -120, 8000])))
    df = spark.createDataFrame(rows, "k int, at bigint, o bigint").repartition(3)
    got = {}
    for r in folds.held_offsets(df, ["k"], "at", "o", 1000, 100).collect():
        got.setdefault(r["k"], []).append((r["at"], r["o"], r["held"]))
    for key in range(8):
        own = sorted(r[1:] for r in rows if r[0] == key)
        near = [math.floor(o / 100 + 0.5) * 100 for _, o in own]
        active, want = near[0], []
        for i, (at, o) in enumerate(own):
            ahead = near[i : i + 15]
            if near[i] - active >= 1000 and sum(abs(x - near[i]) <= 100 for x in ahead) >= max(min(5, len(ahead)), math.ceil(len(ahead) * 0.7)):
                active = near[i]
            want.append((at, o, active))
        assert sorted(got[key]) == want


def plain_hash(p):
    p = np.array(p, float).reshape(32, 32)
    if p.var() < 36:
        return None
    c = np.array([[math.cos((2 * x + 1) * u * math.pi / 64) for x in range(32)] for u in range(8)])
    low = (c @ p @ c.T).ravel()
    middle = np.sort(low[1:])[31]
    bits = sum(1 << i for i in range(1, 64) if low[i] > middle)
    return bits - (1 << 64) if bits >> 63 else bits


def test_hashes_of_pictures(spark):
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:32, :32]
    pictures = [np.clip(rng.normal(120, 40) + 60 * np.sin(x / rng.uniform(1, 9)) * np.cos(y / rng.uniform(1, 9)) + rng.normal(0, 8, (32, 32)), 0, 255).astype(int) for _ in range(12)]
    pictures += [np.zeros((32, 32), int), np.full((32, 32), 200), pictures[0] // 2 + 30]
    df = spark.createDataFrame([(k, p.ravel().tolist()) for k, p in enumerate(pictures)], "k int, p array<int>")
    got = {r["k"]: r["h"] for r in df.select("k", visual.dct_hash(F.col("p")).alias("h")).collect()}
    assert got == {k: plain_hash(p.ravel()) for k, p in enumerate(pictures)}
    assert got[12] is None and got[13] is None and bin((got[0] ^ got[14]) & (1 << 64) - 1).count("1") <= 6


FRAME = "k int, at_ms bigint, hash bigint"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_frame_matches(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    flip = lambda h, n: h ^ sum(1 << b for b in rng.sample(range(64), n))
    target = [(1, 250 * k, h) for k, h in enumerate(base)] + [(1, 250 * (100 + k), base[k]) for k in range(5)] + [(1, 250 * (200 + k), 0x5555) for k in range(9)] + [(2, 0, base[0])]
    source = [(1, 250 * k, flip(h, rng.choice([0, 3, 10, 11]))) for k, h in enumerate(base)] + [(1, 99_000, 0x5557), (1, 99_250, rng.getrandbits(64)), (1, 99_500, None), (2, 250, base[0])]
    frames = [spark.createDataFrame([(k, t, None if h is None else signed(h)) for k, t, h in side], FRAME) for side in (source, target)]
    got = {(r["k"], r["source_ms"]): (r["target_ms"], r["distance"], r["ambiguous"]) for r in visual.frame_matches(*frames, ["k"], most_in_bucket=8).collect()}
    quarters = lambda h: {(q, h >> 16 * q & 65535 ^ m) for q in range(4) for m in [0, *(1 << a for a in range(16)), *(1 << a | 1 << b for a in range(16) for b in range(a))]}
    for k, t, h in source:
        if h is None:
            assert (k, t) not in got
            continue
        own = [(t2, h2) for k2, t2, h2 in target if k2 == k]
        size = {}
        for _, h2 in own:
            for q in range(4):
                size[q, h2 >> 16 * q & 65535] = size.get((q, h2 >> 16 * q & 65535), 0) + 1
        if any(size.get(x, 0) > 8 for x in quarters(h)):
            assert got[k, t] == (None, None, True)
            continue
        near = sorted((bin(h ^ h2).count("1"), t2) for t2, h2 in own if bin(h ^ h2).count("1") <= 10)
        if not near:
            assert (k, t) not in got
        elif any(d <= near[0][0] + 2 and abs(t2 - near[0][1]) > 1000 for d, t2 in near):
            assert got[k, t] == (None, None, True)
        else:
            assert got[k, t] == (near[0][1], near[0][0], False)
    assert sum(x[2] for x in got.values()) >= 6 and sum(not x[2] for x in got.values()) >= 30


def plain_matches(source, target, most_in_bucket, most_candidates):
    """Rows of frame_matches by asking every bucket for every frame."""
    masks = [0, *(1 << a for a in range(16)), *(1 << a | 1 << b for a in range(16) for b in range(a))]
    held, found = {}, {}
    for k, t, h in target:
        for q in range(4):
            held.setdefault((k, q, h >> 16 * q & 65535), []).append((t, h))
    for k, s, h in source:
        full, met = found.setdefault((k, s), [False, set()])
        for q in range(4):
            for m in masks:
                bucket = held.get((k, q, h >> 16 * q & 65535 ^ m), [])
                found[k, s][0] |= len(bucket) > most_in_bucket
                met |= {(h, *x) for x in bucket}
    out = set()
    for (k, s), (full, met) in found.items():
        near = sorted((bin(h ^ y).count("1"), t) for h, t, y in met if bin(h ^ y).count("1") <= 10)
        if full or len(met) > most_candidates or (near and any(d <= near[0][0] + 2 and abs(t - near[0][1]) > 1000 for d, t in near)):
            out.add((k, s, None, None, True))
        elif near:
            out.add((k, s, near[0][1], near[0][0], False))
    return out


def test_frame_matches_in_cells(spark, monkeypatch):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    flip = lambda h, n: h ^ sum(1 << b for b in rng.sample(range(64), n))
    target = [(k, 250 * rng.randrange(300), flip(rng.choice(base), rng.choice([0, 0, 1, 4]))) for k in (1, 2) for _ in range(150)]
    target += target[:9] + [(1, 250 * k, 77) for k in range(12)]
    source = [(k, 250 * j, flip(rng.choice(base), rng.choice([0, 2, 7, 10]))) for k in (1, 2, 3) for j in range(80)]
    source += source[:5] + [(1, 0, base[0]), (1, 90_000, 78)]
    frames = [spark.createDataFrame([(k, t, signed(h)) for k, t, h in side], FRAME).repartition(3) for side in (source, target)]
    for cell, pairs, most, candidates in ((1 << 16, 1 << 18, 10, 9), (40, 5, 10, 9), (3, 50, 100, 6), (1 << 16, 1, 100, 100)):
        monkeypatch.setattr(visual, "CELL_FRAMES", cell)
        monkeypatch.setattr(visual, "PAIRS_EACH", pairs)
        got = [tuple(r) for r in visual.frame_matches(*frames, ["k"], most_in_bucket=most, most_candidates=candidates).collect()]
        assert set(got) == plain_matches(source, target, most, candidates) and len(got) == len(set(got))
        assert any(r[4] for r in got) and sum(not r[4] for r in got) > 20


def test_questions_of_frames_are_not_shuffled(spark):
    """Before, 548 questions of each frame and every candidate were written."""
    rng = random.Random(7)
    frames = [(1, 250 * k, signed(rng.getrandbits(64))) for k in range(500)]
    source = spark.createDataFrame(frames, FRAME)
    jvm, sc = spark.sparkContext._gateway.jvm, spark.sparkContext._jsc.sc()

    def written():
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    before = written()
    assert visual.frame_matches(source, source, ["k"]).filter("NOT ambiguous AND source_ms = target_ms").count() == 500
    assert sum(n for k, n in written().items() if k not in before) < 500 * 20


def test_steady_runs(spark):
    rng = random.Random(5)
    rows = []
    for key in range(10):
        s = t = 0
        for _ in range(rng.randint(5, 120)):
            s += rng.choice([250] * 12 + [500, 1000])
            t += rng.choice([250] * 12 + [500, 1250, 3000])
            rows.append((key, s, t))
    df = spark.createDataFrame(rows, "k int, source_ms bigint, target_ms bigint").repartition(3)
    got = sorted(tuple(r) for r in visual.steady_runs(df, ["k"]).drop("run").collect())
    want = []
    for key in range(10):
        runs, cur = [], []
        for s, t in sorted(r[1:] for r in rows if r[0] == key):
            if cur:
                ds, dt = s - cur[-1][0], t - cur[-1][1]
                far = ds > 750 or dt > 1000 or ds == 0 or dt == 0
                if not far and len(cur) >= 8:
                    slope = (cur[-1][1] - cur[0][1]) / (cur[-1][0] - cur[0][0])
                    far = abs(t - (cur[0][1] + (s - cur[0][0]) * slope)) > 375
                if far:
                    runs.append(cur)
                    cur = []
            cur.append((s, t))
        for run in [*runs, cur]:
            if len(run) >= 8:
                (a, b), (c, d) = run[0], run[-1]
                slope = (d - b) / max(c - a, 1)
                off = max(abs(t - b - (s - a) * slope) for s, t in run)
                if 0.8 <= slope <= 1.25 and off <= 375:
                    want.append((key, a, c, b, d, len(run), off))
    assert got == sorted(want) and len(want) > 3

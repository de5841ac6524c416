"""Offsets of blocks against an exhaustive search, and what blocks agree on against enumeration."""

import itertools
import random

import numpy as np

from tidemark.operators import offsets as O

FRAME = "pair_id int, side string, at_ms bigint, values array<double>"


def test_best_offsets_against_exhaustive_search(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for pair, (n, m) in enumerate([(80, 120), (120, 80), (40, 40), (10, 60), (25, 12)]):
        b = rng.normal(size=(m, 3))
        a = rng.normal(size=(n, 3))
        shift = 17 if m > n else -9
        for i in range(n):
            if 0 <= i + shift < m:
                a[i] = b[i + shift] + rng.normal(0, 0.05, 3)
        rows += [(pair, "source", 500 * i, v.tolist()) for i, v in enumerate(a)] + [(pair, "target", 500 * i + 20, v.tolist()) for i, v in enumerate(b)]
        apart = 500 * (m - 1) + 20 - 500 * (n - 1)
        low, high = max(-240_000, min(0, apart) - 60_000), min(240_000, max(0, apart) + 60_000)
        steps = range(low // 500, -(-high // 500) + 1)

        def search(centre, size):
            best = None
            for k in steps:
                i, j = centre - size // 2, centre - size // 2 + k
                if i < 0 or j < 0 or i + size > n or j + size > m:
                    continue
                d = np.mean([np.sqrt(((a[i + x] - b[j + x]) ** 2).mean()) for x in range(size)])
                if best is None or d < best[1] - 1e-12:
                    best = (k, d)
            return best

        found = [(c, *r) for c in range(12, n - 12, 6) if (r := search(c, 24))]
        found = found or [(n // 2, *r) for r in [search(n // 2, min(24, n))] if r]
        want[pair] = [(c, 500 * c, 500 * k + 20, round(float(d), 9)) for c, k, d in found]
    got = {}
    for r in O.offset_observations(spark.createDataFrame(rows, FRAME).repartition(3)).orderBy("pair_id", "source_index").collect():
        got.setdefault(r["pair_id"], []).append((r["source_index"], r["source_ms"], r["offset_ms"], round(r["distance"], 9)))
    assert got == {p: x for p, x in want.items() if x}
    assert all(x[2] == 17 * 500 + 20 for x in got[0])


def test_crowded_pairs_are_reported(spark, monkeypatch):
    monkeypatch.setattr(O, "MOST_FRAMES", 5)
    rows = [(1, s, 500 * k, [1.0]) for s in ("source", "target") for k in range(6)]
    assert [tuple(r) for r in O.offset_observations(spark.createDataFrame(rows, FRAME)).collect()] == [(1, None, None, None, None)]


def test_pairs_searched_in_pieces_give_the_same(spark, monkeypatch):
    from tidemark.plans import signals

    rng = np.random.default_rng(8)
    rows = []
    for pair, (n, m) in enumerate([(400, 430), (700, 90), (10, 300), (300, 12), (24, 200), (40, 60), (300, 0), (0, 300)]):
        rows += [(pair, side, 500 * i + (side == "target") * 20, rng.integers(0, 2, 2).astype(float).tolist()) for side, size in (("source", n), ("target", m)) for i in range(size)]
    frames = spark.createDataFrame(rows, FRAME).repartition(3)
    whole = sorted(map(tuple, O.offset_observations(frames).collect()))
    monkeypatch.setattr(O, "MOST_FRAMES", 80)
    for size in (7, 50, 1000):
        monkeypatch.setattr(O, "PIECE_FRAMES", size)
        assert sorted(map(tuple, O.offset_observations(frames, pieces=True).collect())) == whole
    assert len({r[0] for r in whole}) == 5 and len(whole) > 150
    monkeypatch.setattr(signals, "_shifted", lambda spark, d: frames)
    assert {r["pair_id"] for r in signals.QUERIES["block_offsets"](spark, "").collect()} == {r[0] for r in whole}


BLOCK = "pair_id int, source_ms bigint, target_ms bigint, score double, margin double, held_out boolean, target_start bigint, target_end bigint"


def test_chains_against_enumeration():
    rng = random.Random(3)
    for _ in range(40):
        islands = []
        for _ in range(rng.randint(0, 7)):
            s, t = rng.randrange(0, 900, 10), rng.randrange(0, 900, 10)
            run = [O._Block(s + 40 * k, t + 40 * k, round(rng.uniform(0.7, 1), 3), 1.0) for k in range(rng.randint(2, 5))]
            islands.append((t - s, run))
        islands.sort(key=lambda i: (i[1][0].target, i[1][0].source))
        best = (0, 0.0)
        for size in range(1, len(islands) + 1):
            for chosen in itertools.combinations(islands, size):
                if all(x[1][-1].target < y[1][0].target and x[1][-1].source < y[1][0].source for x, y in zip(chosen, chosen[1:])):
                    best = max(best, (sum(len(r) for _, r in chosen), round(sum(b.score for _, r in chosen for b in r), 6)))
        chain = O.best_chain(islands)
        assert (sum(len(r) for _, r in chain), round(sum(b.score for _, r in chain for b in r), 6)) == best


def test_located_offsets(spark):
    at = lambda k: 40_000 * k
    one = [(1, at(k), at(k) + 300_000 + 900 * (k % 3), 0.8, 0.2, k % 5 == 2, 0, 1_000_000) for k in range(16)]
    wrong = [(1, 7_000_000 + 11_000_000 * k, at(k), 0.9, 0.2, False, 0, 1_000_000) for k in range(4)]
    two = [(2, at(k), at(k) + (100_000 if k < 8 else 900_000), 0.8, 0.01, k % 5 == 2, 0, 5_000_000) for k in range(16)]
    weak = [(3, at(k), at(k) + 5000, 0.4, 0.2, False, 0, 1_000_000) for k in range(16)]
    short = [(4, at(k), at(k), 0.7, 0.06, False, 0, 40_000_000) for k in range(7)] + [(5, at(k), at(k), 0.6, 0.06, False, 0, 40_000_000) for k in range(7)]
    got = {}
    for r in O.located_offsets(spark.createDataFrame(one + wrong + two + weak + short, BLOCK)).orderBy("pair_id", "rank").collect():
        got.setdefault(r["pair_id"], []).append((r["offset_ms"], r["islands"], r["blocks"], r["tested"]))
    assert got[1] == [(300_900, 1, 13, 3)]
    assert (100_000, 2, 13, 2) in got[2] and got[2][0][1] == 2
    assert 3 not in got and got[4] == [(0, 1, 7, 0)] and 5 not in got


def test_nearly_equal_distances_take_the_smallest_offset():
    # The target holds the source twice, the second time nearer by less than counts.
    a = np.zeros((24, 1))
    b = np.concatenate([np.full((24, 1), 1 + 1e-10), np.ones((24, 1))])
    at, distance = O.best_offsets(a, b, np.array([12]), 24, range(0, 25))
    assert at.tolist() == [0] and abs(distance[0] - 1) < 1e-12


def test_equal_distances_in_long_sequences():
    # The sequence comes again after 150 frames; distances before a block are large, and digits of a running sum go.
    rng = np.random.default_rng(5)
    frame = rng.normal(size=(150, 2))
    b = np.concatenate([rng.normal(size=(3000, 2)) * 1e8, np.tile(frame, (4, 1))])
    a = np.concatenate([np.zeros((3000, 2)), np.tile(frame, (4, 1)) + 0.3])
    centres = np.arange(3000 + 174, 3000 + 400, 6)
    at, distance = O.best_offsets(a, b, centres, 24, range(-150, 151))
    assert set(at.tolist()) == {-150} and np.allclose(distance, 0.3, rtol=0, atol=1e-12)


def test_sides_of_a_pair_meet_after_a_union(spark, tmp_path):
    # Both sides are dealt by pair but differ in size, so adaptive execution joins up their partitions differently.
    from tidemark.plans import registry

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).tolist(), int(label)) for i, label in enumerate(rng.integers(0, 12, 600))]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    names = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB", "spark.sql.unionOutputPartitioning": "true"}
    held = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        found = registry.QUERIES["block_offsets"](spark, str(tmp_path)).collect()
        assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"  # tables this small may come out right all the same
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    sizes = np.bincount([r[2] for r in rows])
    assert len(found) == sum(len(range(12, n - 12, 6)) for n in sizes) and {r["offset_ms"] for r in found if r["source_index"] >= 24} == {-3500}

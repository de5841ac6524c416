"""Batch merges against a plain merge, file by file."""

import random

import pytest

from tidemark.operators import batch as B

FILE = "asset_id int, file_name string, source_order int, season int, first_episode int, last_episode int, part int, known_ms bigint"
ITEM = "asset_id int, item_id int, original_index int, at_ms bigint"
KNOWN = "place int, season int, episode int, length_ms bigint"


def plain(files, items, window, cuts, known):
    segments = []
    for f in files:
        asset, name, order, season, first, last, part, length = f
        own = sorted(((t, i, k) for a, k, i, t in items if a == asset))
        times = [t for t, _, _ in own]
        if last <= first:
            a, b = (times[0], times[-1]) if times else (0, 0)
            end = None if length is None else max(length, b + 1)
            s, e = {"prefix": (0, window.first), "suffix": (max(0, (end or b) - window.first), end or b + 1), "range": (window.first, window.second), "full": (0, end) if end else (a, b + 1)}[window.mode]
            kept = [(t - s, i, k) for t, i, k in own if s <= t < e]
            segments.append((season, first, order, part, name, 0 if e <= s else None if window.mode == "full" and end is None else e - s, kept if e > s else [], asset))
            continue
        n = last - first + 1
        if not times:
            edges = [0] * (n + 1)
        else:
            a, b, edges = times[0], times[-1], None
            if cuts is not None:
                inside = sorted(c for c in cuts if a < c < b)[: n - 1]
                edges = [a, *inside, b + 1] if len(inside) == n - 1 else None
            elif known is not None:
                exact = [next((x[3] for x in known if x[2] == e and (x[1] is None or season is None or x[1] == season)), None) for e in range(first, last + 1)]
                at = [known[e - 1][3] if 0 <= e - 1 < len(known) else None for e in range(first, last + 1)]
                rest = [x[3] for x in known if x[3] > 0][:n]
                chosen = exact if all(x and x > 0 for x in exact) else at if season is None and all(x and x > 0 for x in at) else rest if len(rest) >= n else None
                if chosen:
                    edges = [a + sum(chosen[:k]) for k in range(n + 1)]
            if edges is None:
                step, used, edges = max(1, b - a) / n, set(), [a]
                for k in range(1, n):
                    want, best = a + step * k, None
                    for g, (x, y) in enumerate(zip(times, times[1:])):
                        off = abs((x + y) / 2 - want)
                        if g not in used and off <= step * 0.35 and y - x >= 60_000 and (best is None or y - x - off * 0.2 > best[0]):
                            best = (y - x - off * 0.2, g, (x + y) / 2)
                    if best:
                        used.add(best[1])
                    edges.append(int((best[2] if best else want) + 0.5))
                edges.append(b + 1)
        for k in range(n):
            s, e = edges[k], edges[k + 1]
            kept = [(t - s, i, x) for t, i, x in own if s <= t and (t <= e if k == n - 1 else t < e)]
            segments.append((season, first + k, order, k + 1, name, e - s, kept, asset))
    out, groups = [], {}
    for s in segments:
        groups.setdefault(s[:2], []).append(s)
    for (season, episode), own in groups.items():
        cursor = 0
        for _, _, _, _, _, length, kept, asset in sorted(own, key=lambda s: (s[2], s[3] or 0, s[4])):
            out += [(season, episode, asset, k, t + cursor) for t, _, k in kept]
            cursor += max(0, length if length is not None else max((t for t, _, _ in kept), default=0))
    return sorted(out, key=str), groups


def made(seed):
    rng = random.Random(seed)
    files, items = [], []
    for a in range(24):
        first = rng.randint(1, 5)
        last = first + rng.choice([0, 0, 0, 1, 2])
        files.append((a, f"f{rng.randrange(9)}.xml", rng.randrange(6) * 100 + a, rng.choice([None, 1, 2]), first, last, rng.choice([None, 1, 2]), rng.choice([None, None, 90_000, 4_000_000])))
        t = rng.randrange(5000)
        for k in range(rng.choice([0, 1, 2, 30, 60])):
            t += rng.choice([500, 3000, 20_000, 90_000, 200_000])
            items.append((a, k, rng.randrange(100), t))
    return files, items


@pytest.mark.parametrize(("seed", "window", "cuts", "known"), [
    (1, B.Window(), None, None), (2, B.Window("prefix", 400_000), [600_000, 1_000_000, 1_500_000, 2_000_000], None), (3, B.Window("suffix", 700_000), None, [(0, 1, 1, 300_000), (1, None, 2, 500_000), (2, 2, 3, 0), (3, None, None, 200_000), (4, 1, 2, 9)]),
    (4, B.Window("range", 100_000, 900_000), [5], [(0, None, 1, 5)]), (5, B.Window("range", 900, 100), None, [(k, None, k + 1, 100_000 * (k + 1)) for k in range(8)]),
])
def test_against_a_plain_merge(spark, seed, window, cuts, known):
    files, items = made(seed)
    f, i = spark.createDataFrame(files, FILE).repartition(3), spark.createDataFrame(items, ITEM).repartition(3)
    k = None if known is None else spark.createDataFrame(known, KNOWN)
    segments = B.single_segments(f, i, window).unionByName(B.range_segments(f, i, cuts, k))
    entries = B.merged_entries(segments, i)
    want, groups = plain(files, items, window, cuts, known)
    assert sorted(((r["season"], r["episode"], r["asset_id"], r["item_id"], r["final_ms"]) for r in entries.collect()), key=str) == want
    shown = {(r["season"], r["episode"]): r for r in B.episodes(segments, entries).collect()}
    assert set(shown) == set(groups)
    many = len({s for s, _ in groups if s is not None}) > 1
    for (season, episode), own in groups.items():
        r = shown[season, episode]
        assert r["items"] == sum(len(s[6]) for s in own) and list(r["files"]) == list(dict.fromkeys(s[4] for s in sorted(own, key=lambda s: (s[2], s[4]))))
        assert r["file_name"] == (f"S{season:02}E{episode:02}.xml" if many and season is not None else f"{episode} - {episode}.xml")


def test_warnings(spark):
    files = [(1, "a", 0, None, 1, 1, None, None), (2, "b", 1, None, 1, 2, None, None), (3, "c", 2, None, 1, 2, None, None)]
    items = [(1, 0, 0, 500), (2, 0, 0, 0), (2, 1, 1, 1000)]
    f, i = spark.createDataFrame(files, FILE), spark.createDataFrame(items, ITEM)
    told = lambda df: {(r["asset_id"], r["episode"]): r["warning"] for r in df.collect()}
    assert told(B.single_segments(f, i, B.Window("prefix", 100))) == {(1, 1): "noItems"}
    assert told(B.single_segments(f, i, B.Window("range", 5, 5))) == {(1, 1): "emptyWindow"}
    assert told(B.range_segments(f, i)) == {(2, 1): "even", (2, 2): "even", (3, 1): "noItems", (3, 2): "noItems"}
    assert told(B.range_segments(f, i, cuts=[500])) == {(2, 1): "cuts", (2, 2): "cuts", (3, 1): "noItems", (3, 2): "noItems"}
    short = spark.createDataFrame([(0, None, 1, 10), (1, None, 2, 10)], KNOWN)
    assert told(B.range_segments(f, i, known=short))[2, 1] == "lengthsTail"

"""Where one sequence of frames lies in another: block by block, and the offsets that several blocks agree on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.groups import Group, solve_groups
from tidemark.operators.ordering import numbered

#: Frames of a pair's longer side that a task searches at once; a longer pair is searched in pieces or reported.
MOST_FRAMES = 200_000
#: Source frames at which the blocks of a piece begin.
PIECE_FRAMES = 20_000
#: Farthest offset and what is added to the difference in length on both sides, in ms (fixed values).
FARTHEST_MS, MARGIN_MS = 240_000, 60_000
#: Decimals to which distances are compared; ones that agree in these are equal.
DECIMALS = 9


def searched_steps(source_end: int, target_end: int, step: int) -> range:
    """Offsets in frames that are looked at, which depend on the difference in length."""
    apart = target_end - source_end
    low, high = max(-FARTHEST_MS, min(0, apart) - MARGIN_MS), min(FARTHEST_MS, max(0, apart) + MARGIN_MS)
    return range(low // step, -(-high // step) + 1)


def best_offsets(a: np.ndarray, b: np.ndarray, centres: np.ndarray, block: int, steps: range) -> tuple[np.ndarray, np.ndarray]:
    """(step, least mean distance) at which the block around each centre of ``a`` is nearest to ``b``; no place, no step
    (-1 << 40).  Of distances that agree in DECIMALS the first step's counts.

    Frames' distances are taken once for an offset, and each block sums its own: a sum carried along the sequence
    would lose digits with its length, and equal distances would differ.
    """
    n, m, half = len(a), len(b), block // 2
    best, at, least = np.full(len(centres), np.inf), np.full(len(centres), -1 << 40), np.full(len(centres), np.inf)
    first = centres - half
    for k in steps:
        low, high = max(0, -k), min(n, m - k)  # frames of a that have a counterpart
        if high - low < block:
            continue
        fits = (first >= low) & (first + block <= high)
        if not fits.any():
            continue
        away = a[low:high] - b[low + k : high + k]
        apart = np.sqrt((away * away).mean(axis=1))
        mean = np.lib.stride_tricks.sliding_window_view(apart, block)[first[fits] - low].mean(axis=1)
        index, rounded = np.flatnonzero(fits), np.round(mean, DECIMALS)
        least[index] = np.minimum(least[index], mean)
        nearer = rounded < best[index]
        best[index[nearer]], at[index[nearer]] = rounded[nearer], k
    return at, least


def offset_observations(frames: DataFrame, pair: str = "pair_id", block: int = 24, stride: int = 6, step_ms: int = 500, pieces: bool = False) -> DataFrame:
    """(pair, source_index, source_ms, offset_ms, distance): where blocks of the source lie best in the target.

    ``frames`` is (pair, side 'source' or 'target', at_ms, values), a frame every ``step_ms``; blocks begin every
    ``stride`` frames, and a source shorter than a block is one.  Of equal distances the smallest offset wins.  Pairs
    beyond MOST_FRAMES are searched in ``pieces``, with the same rows; without these they have one row without an
    offset.
    """
    kind = frames.schema[pair].dataType.simpleString()
    source = F.col("side") == "source"
    sizes = frames.groupBy(pair).agg(
        F.count_if(source).alias("_n"), F.greatest(F.count_if(source), F.count_if(~source)).alias("_most"),
        F.max(F.when(source, F.col("at_ms"))).alias("_source_end"), F.max(F.when(~source, F.col("at_ms"))).alias("_target_end"),
    )
    crowded = sizes.filter(F.col("_most") > MOST_FRAMES)
    schema = f"`{pair}` {kind}, source_index bigint, source_ms bigint, offset_ms bigint, distance double"

    def found_in(rows: Group, first: int, n: int, ends: tuple[int, int], last: int, apart: int) -> list[tuple]:
        """The blocks that begin at ``first`` to ``last`` of a source of ``n`` frames, from rows that hold those; the
        source's rows begin at ``first``, the target's ``apart`` frames behind."""
        source = rows["side"] == "source"
        at, bt = rows["at_ms"][source].astype(np.int64), rows["at_ms"][~source].astype(np.int64)
        a, b = (np.array(rows["values"][s].tolist(), float) for s in (source, ~source))
        if not len(a) or not len(b):
            return []
        size, half = block, block // 2
        centres = np.arange(half, n - half, stride)
        centres = centres[(centres - half >= first) & (centres - half < last)] - first
        steps = searched_steps(*ends, step_ms)
        steps = range(steps.start - apart, steps.stop - apart)
        found, distance = best_offsets(a, b, centres, size, steps) if len(centres) else (np.zeros(0, int), np.zeros(0))
        if first == 0 and len(a) == n and not (found > -1 << 40).any():
            size, centres = min(block, n), np.array([n // 2])
            found, distance = best_offsets(a, b, centres, size, steps)
        key = rows[pair][0]
        return [(key, int(first + i), int(at[i]), int(bt[i + k] - at[i]), float(d)) for i, k, d in zip(centres, found, distance, strict=True) if k > -1 << 40]

    def solve(rows: Group) -> list[tuple]:
        source = rows["side"] == "source"
        n = int(source.sum())
        if not n or n == len(source):
            return []
        return found_in(rows, 0, n, (int(rows["at_ms"][source][-1]), int(rows["at_ms"][~source][-1])), n, 0)

    def solve_piece(rows: Group) -> list[tuple]:
        source = rows["side"] == "source"
        if source.all() or not source.any():
            return []
        first, apart = int(rows["_pos"][source][0]), int(rows["_pos"][~source][0]) - int(rows["_pos"][source][0])
        return found_in(rows, first, int(rows["_n"][0]), (int(rows["_source_end"][0]), int(rows["_target_end"][0])), first + PIECE_FRAMES, apart)

    wanted = frames.select(pair, "side", "at_ms", "values").join(crowded, pair, "left_anti")
    out = solve_groups(wanted, [pair], ["at_ms"], solve, schema)
    if not pieces:
        return out.unionByName(crowded.select(pair), allowMissingColumns=True)
    if crowded.isEmpty():
        return out
    # A block is compared with the target from the least to the farthest offset only, so a piece needs no more of it.
    placed = numbered(frames.select(pair, "side", "at_ms", "values").join(crowded, pair), [pair, "side"], "at_ms", pos="_pos")
    apart = F.col("_target_end") - F.col("_source_end")
    low = F.floor(F.greatest(F.lit(-FARTHEST_MS), F.least(F.lit(0), apart) - MARGIN_MS) / step_ms)
    high = F.ceil(F.least(F.lit(FARTHEST_MS), F.greatest(F.lit(0), apart) + MARGIN_MS) / step_ms)
    begin, end = F.when(source, F.lit(0)).otherwise(low), F.when(source, F.lit(0)).otherwise(high)
    from_ = F.greatest(F.lit(0), F.floor((F.col("_pos") - block - end) / PIECE_FRAMES))
    to = F.least(F.floor((F.col("_n") - 1) / PIECE_FRAMES), F.floor((F.col("_pos") - begin) / PIECE_FRAMES))
    dealt = placed.withColumn("_piece", F.explode(F.when(from_ <= to, F.sequence(from_, to))))
    return out.unionByName(solve_groups(dealt, [pair, "_piece"], ["_pos"], solve_piece, schema))


@dataclass(frozen=True)
class PlaceRules:
    frame_ms: int = 500
    stride_ms: int = 30_000
    least_score: float = 0.48
    least_margin: float = 0.001
    tolerance_ms: int = 120_000
    least: int = 5
    most: int = 3


#: What a single offset must cover of the target; what a part must have without that: blocks, length in ms, score and
#: margin of each (fixed values).
LEAST_COVER, PART_BLOCKS, PART_MS, PART_SCORE, PART_MARGIN = 0.35, 6, 120_000, 0.65, 0.05
#: Of several offsets together: score of each block, blocks, width of an island, and what they must cover (fixed values).
ISLAND_SCORE, ISLAND_BLOCKS, ISLAND_MS, ISLAND_COVER = 0.70, 6, 30_000, 0.20
#: Weights of score, cover and support, and the blocks of full support (fixed values).
WEIGHTS, FULL_SUPPORT = (0.50, 0.30, 0.20), 16


@dataclass
class _Block:
    source: int
    target: int
    score: float
    margin: float

    @property
    def offset(self) -> int:
        return self.target - self.source


def _middle(offsets: list[int]) -> int:
    return sorted(offsets)[len(offsets) // 2]


def islands_of(blocks: list[_Block], rules: PlaceRules) -> list[tuple[int, list[_Block]]]:
    """(offset, blocks) of groups of nearly one offset whose blocks run forward on both sides."""
    width = max(min(rules.tolerance_ms, ISLAND_MS), rules.frame_ms * 4)
    rest = sorted((b for b in blocks if b.score >= max(rules.least_score, ISLAND_SCORE)), key=lambda b: b.offset)
    if len(rest) < max(rules.least, ISLAND_BLOCKS):
        return []
    out = []
    while rest:
        group = [b for b in rest if b.offset - rest[0].offset <= width]
        rest = rest[len(group) :]
        offset = _middle([b.offset for b in group])
        kept: dict[int, _Block] = {}
        for b in sorted((b for b in group if abs(b.offset - offset) <= width), key=lambda b: b.target):
            kept.setdefault(b.target, b)
        run = list(kept.values())
        rising = all(x.source < y.source for x, y in zip(run, run[1:]))
        if len(group) >= 2 and len(run) >= 2 and rising and min(run[-1].source - run[0].source, run[-1].target - run[0].target) >= rules.stride_ms:
            out.append((offset, run))
    return sorted(out, key=lambda i: (i[1][0].target, i[1][0].source))


def best_chain(islands: list[tuple[int, list[_Block]]]) -> list[tuple[int, list[_Block]]]:
    """The islands, one behind the other on both sides, that hold most blocks; of as many the higher scores."""
    best: list[tuple[int, float, int]] = []
    for k, (_, run) in enumerate(islands):
        own = (len(run), sum(b.score for b in run))
        found = (*own, -1)
        for j in range(k):
            before = islands[j][1][-1]
            if before.target < run[0].target and before.source < run[0].source:
                total = (best[j][0] + own[0], best[j][1] + own[1])
                if total > found[:2]:
                    found = (*total, j)
        best.append(found)
    out, k = [], max(range(len(best)), key=lambda i: (best[i][:2], i), default=-1)
    while k >= 0:
        out.append(islands[k])
        k = best[k][2]
    return out[::-1]


def places_of(blocks: list[_Block], held_out: list[_Block], bounds: tuple[int, int], rules: PlaceRules) -> list[dict]:
    """Ranked offsets, a chain of several among them, that enough blocks agree on."""
    usable = [b for b in blocks if b.score >= rules.least_score and b.margin >= rules.least_margin]
    if len(usable) < rules.least:
        return []
    whole = max(1, bounds[1] - bounds[0])
    tests = [b for b in held_out if b.score >= rules.least_score]
    found = []

    def made(parts: list[tuple[int, list[_Block]]], cover: float, tested: int) -> dict:
        off = sorted(abs(b.offset - offset) for offset, run in parts for b in run)
        n = len(off)
        score = sum(b.score for _, run in parts for b in run) / n * WEIGHTS[0] + min(1.0, max(0.0, cover)) * WEIGHTS[1] + min(1.0, n / FULL_SUPPORT) * WEIGHTS[2]
        sources = [b.source for _, run in parts for b in run]
        return {"offset_ms": parts[0][0], "islands": len(parts), "blocks": n, "tested": tested, "source_start": min(sources), "source_end": max(sources), "cover": min(1.0, max(0.0, cover)), "p95_ms": off[-(-(n - 1) * 95 // 100)], "score": min(1.0, max(0.0, score))}

    for seed in sorted({b.offset for b in usable}):
        near = [b for b in usable if abs(b.offset - seed) <= rules.tolerance_ms]
        if len(near) < rules.least:
            continue
        offset = _middle([b.offset for b in near])
        near = [b for b in near if abs(b.offset - offset) <= rules.tolerance_ms]
        if len(near) < rules.least:
            continue
        span = max(b.target for b in near) - min(b.target for b in near)
        strong = all(b.score >= max(rules.least_score, PART_SCORE) and b.margin >= max(rules.least_margin, PART_MARGIN) and abs(b.offset - offset) <= 2 * max(rules.frame_ms, 500) for b in near)
        if span / whole >= LEAST_COVER or (strong and len(near) >= PART_BLOCKS and span >= PART_MS):
            found.append(made([(offset, near)], span / whole, len(tests)))
    chain = best_chain(islands_of(usable, rules))
    if len(chain) >= 2 and sum(len(run) for _, run in chain) >= max(rules.least, ISLAND_BLOCKS):
        cover = (chain[-1][1][-1].target - chain[0][1][0].target) / whole
        if cover >= ISLAND_COVER:
            inside = lambda b, run: all(x - rules.stride_ms <= v <= y + rules.stride_ms for v, x, y in ((b.target, run[0].target, run[-1].target), (b.source, run[0].source, run[-1].source)))
            high = [b for b in held_out if b.score >= max(rules.least_score, ISLAND_SCORE)]
            found.append(made(chain, cover, sum(any(inside(b, run) for _, run in chain) for b in high)))
    found.sort(key=lambda f: (-f["blocks"], -f["islands"], -f["cover"], -f["score"], f["p95_ms"], f["offset_ms"]))
    out: list[dict] = []
    for f in found:
        if len(out) < rules.most and not any(o["islands"] == f["islands"] and abs(o["offset_ms"] - f["offset_ms"]) <= rules.tolerance_ms for o in out):
            out.append(f)
    return out


PLACE_SCHEMA = "rank int, offset_ms bigint, islands int, blocks int, tested int, source_start bigint, source_end bigint, cover double, p95_ms bigint, score double"


def located_offsets(blocks: DataFrame, pair: str = "pair_id", rules: PlaceRules = PlaceRules()) -> DataFrame:
    """The best offsets of every pair, ranked from 1.

    ``blocks`` is (pair, source_ms, target_ms, score, margin, held_out, target_start, target_end), a pair's query
    blocks, of which there are few.  Blocks held out never propose an offset; ``tested`` counts those that may judge it.
    """
    kind = blocks.schema[pair].dataType.simpleString()
    names = [x.split()[0] for x in PLACE_SCHEMA.split(", ")][1:]

    def solve(rows: Group) -> list[tuple]:
        made = [_Block(int(s), int(t), float(c), float(m)) for s, t, c, m in zip(rows["source_ms"], rows["target_ms"], rows["score"], rows["margin"], strict=True)]
        out = rows["held_out"].astype(bool)
        places = places_of([b for b, x in zip(made, out, strict=True) if not x], [b for b, x in zip(made, out, strict=True) if x], (int(rows["target_start"][0]), int(rows["target_end"][0])), rules)
        return [(rows[pair][0], k + 1, *(p[n] for n in names)) for k, p in enumerate(places)]

    return solve_groups(blocks, [pair], ["target_ms", "source_ms"], solve, f"`{pair}` {kind}, {PLACE_SCHEMA}")

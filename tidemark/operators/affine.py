"""Straight lines between two clocks from noisy pairs of times, fitted on one part and tested on another.

A pair of media has observations (source item and time, target item and time).  One-second blocks of the source are
set aside first, spread evenly, and never enter a fit.  Lines through single observations and through pairs of them
are refitted to the observations they explain and ranked.  A pair has at most MOST_OBSERVATIONS; one with more is
reported, not read.  What a line explains, and what the blocks set aside say about it, are windows and joins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.groups import Group, solve_groups

#: Observations of a pair, seeds, and seeds with scale 1 among them (fixed values).
MOST_OBSERVATIONS, MOST_SEEDS, PLAIN_SEEDS = 40_000, 768, 256
#: Observations that plain and paired seeds are taken from, and the least source distance of a pair in ms (fixed values).
PLAIN_FROM, PAIRED_FROM, LEAST_APART = 96, 48, 500
#: Lines as near as this are one (fixed values).
SAME_SCALE, SAME_OFFSET = 0.0005, 40
#: Length of a block in ms, blocks set aside at most, and how many blocks there are for one set aside (fixed values).
BLOCK_MS, MOST_BLOCKS, BLOCKS_EACH = 1_000, 1_024, 5
#: Cells of the held-out test: width in time and offset, cells to each side in time, and least different witnesses
#: (fixed values).
CELL_MS, CELL_OFFSET_MS, CELL_REACH, LEAST_WITNESSES = 5_000, 250, 2, 3
#: Cells of lines and observations that are looked at together.
CELLS_EACH = 1 << 16
#: Share of the first line's inliers from which another explains as good as as much (fixed value).
AS_MANY = 0.98


@dataclass(frozen=True)
class LineRules:
    least_scale: float = 0.94
    most_scale: float = 1.06
    tolerance_ms: int = 90
    least: int = 4
    top: int = 5


LINE_SCHEMA = "rank int, scale double, offset_ms bigint, fitted_offset_ms double, inliers int, source_share double, target_share double, source_start_ms bigint, source_end_ms bigint, p50_ms bigint, p95_ms bigint, max_ms bigint, margin double, seeds int, held_out_blocks array<bigint>, fault string"


def _mixed(x: int) -> int:
    """A 64-bit number whose bits all depend on all of ``x``."""
    mask = (1 << 64) - 1
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor & mask
    return x ^ (x >> 31)


def held_out_blocks(items: np.ndarray, at: np.ndarray, least: int) -> list[int]:
    """One block from each of evenly wide parts of the blocks; a block whose items the fit needs stays in it."""
    blocks, place = np.unique(at // BLOCK_MS, return_inverse=True)
    left = set(items.tolist())
    n = len(blocks)
    if len(left) < least + 2 or n < 3:
        return []
    count = min(max(-(-n // BLOCKS_EACH), 2), n - 1, MOST_BLOCKS)
    mask = (1 << 64) - 1
    turned = (n << 17 | n >> 47) & mask
    picked = set()
    for slot in range(count):
        start, stop = slot * n // count, max((slot + 1) * n // count, slot * n // count + 1)
        picked.add(start + _mixed(((slot + 1) * 0x9E3779B97F4A7C15 & mask) ^ turned) % (stop - start))
    out = []
    order = np.argsort(place, kind="stable")
    ends = np.searchsorted(place[order], np.arange(n + 1))
    for k in sorted(picked):
        own = set(items[order[ends[k] : ends[k + 1]]].tolist())
        if len(left) - len(left & own) >= least:
            left -= own
            out.append(int(blocks[k]))
        else:
            left |= own
    return out if len(out) >= 2 else []


class _Observations:
    """Observations in order of source time, target time and source item."""

    def __init__(self, s: np.ndarray, t: np.ndarray, item: np.ndarray, target: np.ndarray):
        order = np.lexsort((item, t, s))
        self.s, self.t, self.item, self.target = s[order], t[order], item[order], target[order]

    def subset(self, keep: np.ndarray) -> _Observations:
        return _Observations(self.s[keep], self.t[keep], self.item[keep], self.target[keep])

    def seeds(self, rules: LineRules) -> list[tuple[float, float]]:
        n = len(self.s)
        out = [(1.0, float(self.t[k] - self.s[k])) for k in range(0, n, max(1, n // PLAIN_FROM))][:PLAIN_SEEDS]
        step = max(1, n // PAIRED_FROM)
        for i in range(0, n, step):
            j = np.arange(i + 1, n, step)
            across, up = self.s[j] - self.s[i], self.t[j] - self.t[i]
            fine = (self.item[j] != self.item[i]) & (np.abs(across) >= LEAST_APART)
            scales = up[fine] / across[fine]
            for scale in scales[(scales >= rules.least_scale) & (scales <= rules.most_scale)]:
                out.append((float(scale), float(self.t[i] - scale * self.s[i])))
                if len(out) >= MOST_SEEDS:
                    return out
        return out


class _Placed:
    """Observations in order of source time and source item, for many lines at once."""

    def __init__(self, obs: _Observations):
        n = len(obs.s)
        order = np.lexsort((obs.item, obs.s))
        self.s, self.t = obs.s[order].astype(float), obs.t[order].astype(float)
        _, self.code, counts = np.unique(obs.item[order], return_inverse=True, return_counts=True)
        self.rank = np.empty(n, np.int64)
        self.rank[np.lexsort((order, self.t))] = np.arange(n)
        self.by_item = np.argsort(self.code, kind="stable") if (counts > 1).any() else None
        self.starts = np.cumsum(counts) - counts

    def explained(self, lines: list[tuple[float, float]], tolerance: int) -> list[np.ndarray]:
        """For each line the places of the best observation of each item as far as target times rise."""
        n, found = len(self.s), []
        each = max(1, CELLS_EACH // max(n, 1))
        s, t = self.s[:, None], self.t[:, None]
        for k in range(0, len(lines), each):
            scales, offsets = np.array(lines[k : k + each]).T
            away = s * scales
            away += offsets
            np.subtract(t, away, out=away)
            np.abs(away, out=away)
            away += 0.5
            near = away < tolerance + 1
            if self.by_item is not None:  # the least residual of an item counts, then the least target time
                key = np.where(near, np.floor(np.minimum(away, tolerance + 1)).astype(np.int64) * n + self.rank[:, None], np.iinfo(np.int64).max)
                near &= key == np.minimum.reduceat(key[self.by_item], self.starts, axis=0)[self.code]
            highest = np.where(near, t, -np.inf)
            np.maximum.accumulate(highest, axis=0, out=highest)
            near[1:] &= t[1:] > highest[:-1]
            found.extend(np.ascontiguousarray(near.T))
        return found


def _refitted(x: np.ndarray, y: np.ndarray) -> tuple[float, float] | None:
    """(scale, offset) of the least squares line through points, if they do not share one time."""
    n = len(x)
    middle, height = np.add.reduce(x) / n, np.add.reduce(y) / n
    across = x - middle
    spread = np.add.reduce(across * across)
    if spread <= np.finfo(float).eps:
        return None
    scale = float(np.add.reduce(across * (y - height)) / spread)
    return scale, float(height - scale * middle)


def refined(placed: _Placed, seeds: list[tuple[float, float]], rules: LineRules) -> list[tuple[float, float, np.ndarray]]:
    """(scale, offset, places explained) of the different lines that seeds come to when each is refitted twice, in the
    order of their first seeds.  Seeds that explain the same are one from then on."""
    lines = list(dict.fromkeys(seeds))
    for _ in range(2):
        kept = {near.tobytes(): near for near in placed.explained(lines, rules.tolerance_ms)}
        again: dict[tuple[float, float], None] = {}
        for near in kept.values():
            at = np.flatnonzero(near)
            line = _refitted(placed.s[at], placed.t[at]) if len(at) >= max(2, rules.least) else None
            if line and rules.least_scale <= line[0] <= rules.most_scale:
                again[line] = None
        lines = list(again)
    return [(*line, np.flatnonzero(near)) for line, near in zip(lines, placed.explained(lines, rules.tolerance_ms), strict=True)]


def lines_of(obs: _Observations, sources: int, targets: int, rules: LineRules) -> tuple[list[dict], list[int], int]:
    """Ranked lines, the blocks set aside, and the number of seeds."""
    blocks = held_out_blocks(obs.item, obs.s, rules.least)
    fit = obs.subset(~np.isin(obs.s // BLOCK_MS, blocks))
    if len(fit.s) < rules.least:
        fit, blocks = obs, []
    found: list[dict] = []
    seeds = fit.seeds(rules)
    placed = _Placed(fit)
    for scale, offset, near in refined(placed, seeds, rules):
        n = len(near)
        whole = int(np.floor(abs(offset) + 0.5)) * (1 if offset >= 0 else -1)
        if n < rules.least or n == 0 or any(abs(f["scale"] - scale) < SAME_SCALE and abs(f["offset_ms"] - whole) < SAME_OFFSET for f in found):
            continue
        away = np.floor(np.abs(placed.t[near] - (scale * placed.s[near] + offset)) + 0.5).astype(np.int64)
        ordered = np.sort(away)
        at = lambda q: int(ordered[int(np.ceil((n - 1) * q))])  # noqa: B023, E731
        found.append({"scale": scale, "offset_ms": whole, "fitted_offset_ms": offset, "inliers": n, "source_share": n / max(sources, 1), "target_share": n / max(targets, 1), "source_start_ms": int(placed.s[near].min()), "source_end_ms": int(placed.s[near].max()), "p50_ms": at(0.5), "p95_ms": at(0.95), "max_ms": int(ordered[-1])})
    found.sort(key=lambda f: (-f["inliers"], f["p95_ms"], -f["source_share"], -f["target_share"], abs(f["offset_ms"]), f["scale"]))
    return found, blocks, len(seeds)


def affine_lines(observations: DataFrame, pair: str = "pair_id", rules: LineRules = LineRules(), tightest: bool = False) -> DataFrame:
    """The best ``top`` lines of every pair, ranked from 1, and if ``tightest`` the one that `tightest_lines` takes,
    whatever its rank.

    ``observations`` is (pair, source_index, target_index, source_ms, target_ms).  More inliers come first, then the
    smaller 95th percentile of residuals.  ``margin`` is the first line's lead over the second.  Shares are of the
    pair's items.  A pair with too many observations, or without a line, has one row with a ``fault`` and no line.
    """
    counts = observations.groupBy(pair).agg(F.count(F.lit(1)).alias("_n"))
    crowded = counts.filter(F.col("_n") > MOST_OBSERVATIONS).select(pair)
    kind = observations.schema[pair].dataType.simpleString()
    names = [x.split()[0] for x in LINE_SCHEMA.split(", ")]

    def solve(rows: Group) -> list[tuple]:
        columns = [rows[c].astype(np.int64) for c in ("source_ms", "target_ms", "source_index", "target_index")]
        found, blocks, seeds = lines_of(_Observations(*columns), len(np.unique(columns[2])), len(np.unique(columns[3])), rules)
        worth = [f["inliers"] - f["p95_ms"] / (rules.tolerance_ms * 2) for f in found[:2]]
        margin = min(1.0, max(0.0, (max(worth[0], 0.001) - (worth[1] if len(worth) > 1 else 0.0)) / max(worth[0], 0.001))) if found else 0.0
        shown = set(range(min(rules.top, len(found))))
        if tightest and found:
            shown.add(min((k for k, f in enumerate(found) if f["inliers"] >= found[0]["inliers"] * AS_MANY), key=lambda k: (found[k]["p95_ms"], k)))
        out = [{**found[k], "rank": k + 1, "margin": margin, "seeds": seeds, "held_out_blocks": blocks} for k in sorted(shown)]
        out = out or [{"margin": 0.0, "seeds": seeds, "held_out_blocks": blocks, "fault": "none"}]
        return [(rows[pair][0], *(x.get(name) for name in names)) for x in out]

    wanted = observations.select(pair, "source_index", "target_index", "source_ms", "target_ms").dropna()
    found = solve_groups(wanted.join(crowded, pair, "left_anti"), [pair], [], solve, f"`{pair}` {kind}, {LINE_SCHEMA}")
    return found.unionByName(crowded.withColumn("fault", F.lit("crowded")), allowMissingColumns=True)


def tightest_lines(lines: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Of each pair's ``lines`` the one with the smallest 95th percentile among those that explain as good as as much
    as the first; pairs with a fault are left out.

    A line may lie aslant and catch a stray observation at the tolerance that the true one leaves: it is ranked first
    by one inlier, with residuals several times as large.
    """
    first = F.max("inliers").over(W.partitionBy(pair))
    near = lines.filter("fault IS NULL").withColumn("_first", first).filter(F.col("inliers") >= F.col("_first") * AS_MANY)
    return near.groupBy(pair).agg(F.min_by(F.struct(*[c for c in lines.columns if c != pair]), F.struct("p95_ms", "rank")).alias("_l")).select(pair, "_l.*").select(*lines.columns)


def _against(observations: DataFrame, lines: DataFrame, pair: str) -> DataFrame:
    """Observations with each line of their pair; ``aside`` tells those of the blocks set aside, ``off_ms`` how far off."""
    line = lines.filter("fault IS NULL").select(pair, "rank", "scale", "offset_ms", "fitted_offset_ms", "held_out_blocks")
    rows = observations.join(line, pair).withColumn("aside", F.array_contains("held_out_blocks", F.floor(F.col("source_ms") / BLOCK_MS)))
    return rows.drop("held_out_blocks")


def _away(offset: str) -> Column:
    return F.col("target_ms") - (F.col("scale") * F.col("source_ms") + F.col(offset))


def training_anchors(observations: DataFrame, lines: DataFrame, pair: str = "pair_id", rules: LineRules = LineRules()) -> DataFrame:
    """(pair, rank, source_ms, target_ms, residual_ms): what each line explains of the observations it was fitted to."""
    rows = _against(observations, lines, pair).filter("NOT aside")
    rows = rows.withColumn("residual_ms", F.floor(F.abs(_away("fitted_offset_ms")) + 0.5).cast("long")).filter(F.col("residual_ms") <= rules.tolerance_ms)
    best = rows.groupBy(pair, "rank", "source_index").agg(F.min(F.struct("residual_ms", "target_ms", "target_index", "source_ms")).alias("b")).select(pair, "rank", "source_index", "b.*")
    before = W.partitionBy(pair, "rank").orderBy("source_ms", "source_index").rowsBetween(W.unboundedPreceding, -1)
    highest = F.max("target_ms").over(before)
    rising = best.withColumn("_highest", highest).filter(F.col("_highest").isNull() | (F.col("target_ms") > F.col("_highest")))
    return rising.select(pair, "rank", "source_ms", "target_ms", "residual_ms")


def held_out_anchors(observations: DataFrame, lines: DataFrame, pair: str = "pair_id", rules: LineRules = LineRules()) -> DataFrame:
    """(pair, rank, source_ms, target_ms, residual_ms, within): what the blocks set aside have for each line.

    An observation near the line counts; one further off counts if, around its time and offset, at least three
    different source items, target items, source seconds and target seconds agree.  The nearest of an item is kept.
    """
    off = _away("offset_ms")
    signed = (F.signum(off) * F.floor(F.abs(off) + 0.5)).cast("long")
    rows = _against(observations, lines, pair).filter("aside").withColumn("off_ms", signed)
    rows = rows.withColumns({"residual_ms": F.abs("off_ms"), "cell_t": F.floor(F.col("source_ms") / CELL_MS), "cell_o": F.floor(F.col("off_ms") / CELL_OFFSET_MS)})
    within = F.col("residual_ms") <= rules.tolerance_ms
    # Rows near the line count anyhow, so only cells that hold one further off ask the cells around them.
    cells = [pair, "rank", "cell_t", "cell_o"]
    reach = [F.struct((F.col("cell_t") + a).alias("near_t"), (F.col("cell_o") + b).alias("near_o")) for a in range(-CELL_REACH, CELL_REACH + 1) for b in (-1, 0, 1)]
    asking = rows.filter(~within).select(*cells).distinct().withColumn("_r", F.explode(F.array(*reach))).select(*cells, "_r.*")
    around = rows.select(pair, "rank", F.col("cell_t").alias("near_t"), F.col("cell_o").alias("near_o"), "source_index", "target_index", "source_ms", "target_ms")
    seconds = [F.floor(F.col(c) / BLOCK_MS) for c in ("source_ms", "target_ms")]
    witnesses = [F.size(F.collect_set(x)) for x in (F.col("source_index"), F.col("target_index"), *seconds)]
    told = asking.join(around, [pair, "rank", "near_t", "near_o"]).groupBy(*cells)
    enough = told.agg(F.least(*witnesses).alias("_w")).filter(F.col("_w") >= LEAST_WITNESSES)
    kept = rows.join(enough, cells, "left").filter(within | F.col("_w").isNotNull())
    best = kept.groupBy(pair, "rank", "source_index").agg(F.min(F.struct("residual_ms", "target_ms", "source_ms")).alias("b")).select(pair, "rank", "b.*")
    return best.select(pair, "rank", "source_ms", "target_ms", "residual_ms", within.alias("within"))

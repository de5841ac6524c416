"""Alignment of feature sequences, one media pair per group.

Each group is one pair of editions; its size is bounded by ``cells``, above which the pair must be tiled first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Bound on a pair's dynamic-programming table.
MOST_CELLS = 16_000_000


def edit_alignment(frames: DataFrame, pair: str = "pair_id", gap: float = 0.3, most_cells: int = MOST_CELLS) -> DataFrame:
    """Spans (matched, sourceOnly, targetOnly) of the cheapest alignment of two feature sequences per pair.

    ``frames`` is (pair, side 'source' or 'target', position, values); matching costs the root-mean-square distance,
    leaving a frame out costs ``gap``; of equal paths the one that matches first wins.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        a, b = (np.array(rows[rows["side"] == s]["values"].tolist(), float) for s in ("source", "target"))
        if len(a) * len(b) > most_cells:
            raise ValueError(f"pair {rows[pair].iloc[0]!r} needs {len(a) * len(b)} cells; tile it first")
        cost = np.zeros((len(a) + 1, len(b) + 1))
        cost[:, 0], cost[0, :] = gap * np.arange(len(a) + 1), gap * np.arange(len(b) + 1)
        near = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).mean(axis=2)) if len(a) and len(b) else np.zeros((len(a), len(b)))
        steps = gap * np.arange(len(b) + 1)
        for i in range(1, len(a) + 1):
            best = np.empty(len(b) + 1)
            best[0] = cost[i, 0]
            best[1:] = np.minimum(cost[i - 1, :-1] + near[i - 1], cost[i - 1, 1:] + gap)
            cost[i] = np.minimum.accumulate(best - steps) + steps
        i, j, ops = len(a), len(b), []
        while i or j:
            if i and j and np.isclose(cost[i, j], cost[i - 1, j - 1] + near[i - 1, j - 1]):
                i, j = i - 1, j - 1
                ops.append(("matched", i, j))
            elif i and np.isclose(cost[i, j], cost[i - 1, j] + gap):
                i -= 1
                ops.append(("sourceOnly", i, j))
            else:
                j -= 1
                ops.append(("targetOnly", i, j))
        out: list[list] = []
        for kind, i, j in reversed(ops):
            s, t = int(kind != "targetOnly"), int(kind != "sourceOnly")
            if out and out[-1][0] == kind:
                out[-1][2] += s
                out[-1][4] += t
            else:
                out.append([kind, i, i + s, j, j + t])
        frame = pd.DataFrame(out, columns=["kind", "source_start", "source_end", "target_start", "target_end"])
        frame.insert(0, "span_index", np.arange(len(frame)))
        frame.insert(0, pair, rows[pair].iloc[0])
        return frame

    kind = frames.schema[pair].dataType.simpleString()
    return frames.groupBy(pair).applyInPandas(solve, f"{pair} {kind}, span_index bigint, kind string, source_start bigint, source_end bigint, target_start bigint, target_end bigint")


def best_path(candidates: DataFrame, chain: str = "chain_id", overlap: float = 0.3) -> DataFrame:
    """The best candidate per part of a chain (Viterbi): scores add up, going back on the target axis costs ``overlap``.

    ``candidates`` is (chain, part, candidate, score, target_start, target_end).
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [g.sort_values("candidate").reset_index(drop=True) for _, g in rows.groupby("part", sort=True)]
        best, back = parts[0]["score"].to_numpy(float), []
        for before, now in zip(parts, parts[1:]):
            goes_back = before["target_end"].to_numpy()[:, None] > now["target_start"].to_numpy()[None, :]
            total = best[:, None] - overlap * goes_back
            back.append(total.argmax(axis=0))
            best = total.max(axis=0) + now["score"].to_numpy(float)
        k, chosen = int(best.argmax()), []
        for n in range(len(parts) - 1, -1, -1):
            chosen.append(parts[n].iloc[k])
            k = int(back[n - 1][k]) if n else k
        out = pd.DataFrame(chosen[::-1])[[chain, "part", "candidate"]]
        out["total"] = float(best.max())
        return out

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return candidates.groupBy(chain).applyInPandas(solve, f"{chain} {kinds[chain]}, part {kinds['part']}, candidate {kinds['candidate']}, total double")


def assign(scores: DataFrame, group: str = "group_id", least: float = 0.0) -> DataFrame:
    """One-to-one assignment of sources to targets with the largest total, per group (augmenting paths by prices).

    ``scores`` is (group, source, target, score); pairs under ``least`` are never chosen.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        s, t = sorted(rows["source"].unique()), sorted(rows["target"].unique())
        gain = np.zeros((len(s), len(t) + len(s)))
        si, ti = {v: k for k, v in enumerate(s)}, {v: k for k, v in enumerate(t)}
        for a, b, v in rows[["source", "target", "score"]].itertuples(index=False):
            gain[si[a], ti[b]] = max(0.0, v - least)
        n, m = gain.shape
        u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
        for i in range(1, n + 1):
            match[0], j0 = i, 0
            low, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
            while True:
                used[j0] = True
                i0 = match[j0]
                free = np.flatnonzero(~used[1:]) + 1
                d = -gain[i0 - 1, free - 1] - u[i0] - v[free]
                better = d < low[free]
                low[free[better]], way[free[better]] = d[better], j0
                j1 = free[low[free].argmin()]
                delta = low[j1]
                u[match[used]] += delta
                v[used] -= delta
                low[~used] -= delta
                j0 = j1
                if match[j0] == 0:
                    break
            while j0:
                match[j0] = match[way[j0]]
                j0 = way[j0]
        got = [(s[match[j] - 1], t[j - 1], float(gain[match[j] - 1, j - 1] + least)) for j in range(1, len(t) + 1) if match[j] and gain[match[j] - 1, j - 1] > 0]
        out = pd.DataFrame(sorted(got), columns=["source", "target", "score"])
        out.insert(0, group, rows[group].iloc[0])
        return out

    kinds = {f.name: f.dataType.simpleString() for f in scores.schema}
    return scores.groupBy(group).applyInPandas(solve, f"{group} {kinds[group]}, source {kinds['source']}, target {kinds['target']}, score double")


def boundary_offset(windows: DataFrame, key: str = "key", radius: int = 20) -> DataFrame:
    """The lag in [-radius, radius] at which two windows correlate best, with the correlation and its lead.

    ``windows`` is (key, source array, target array); the lead is over the best lag that is not next to the winner.
    """

    def solve(batches):
        for rows in batches:
            out = []
            for k, a, b in rows[[key, "source", "target"]].itertuples(index=False):
                a, b, found = np.asarray(a, float), np.asarray(b, float), []
                for lag in range(-radius, radius + 1):
                    x, y = (a[lag:], b[: len(a) - lag]) if lag >= 0 else (a[:lag], b[-lag:])
                    n = min(len(x), len(y))
                    x, y = x[:n] - x[:n].mean() if n else x, y[:n] - y[:n].mean() if n else y
                    size = np.sqrt((x * x).sum() * (y * y).sum()) if n > 2 else 0.0
                    found.append((float((x * y).sum() / size) if size else -1.0, -abs(lag), lag))
                best = max(found)
                rest = [f[0] for f in found if abs(f[2] - best[2]) > 1]
                out.append((k, best[2], best[0], best[0] - max(rest, default=-1.0)))
            yield pd.DataFrame(out, columns=[key, "lag", "correlation", "lead"])

    kind = windows.schema[key].dataType.simpleString()
    return windows.select(key, "source", "target").mapInPandas(solve, f"{key} {kind}, lag bigint, correlation double, lead double")

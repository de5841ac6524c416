"""Alignment of feature frames with opening and extension costs for what only one side has.

A pair's frames are aligned by dynamic programming over three states (both sides advance, only the source, only the
target) inside a band around a straight line between the two clocks.  Memory and time follow the cells of the band;
pairs with more than ``most_cells`` of them are not tried and say so.  Paths leave as rows, one for each step, and
everything behind them is joins and windows over a pair's rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.intervals import runs

MATCHED, SOURCE_ONLY, TARGET_ONLY, AMBIGUOUS = "matched", "sourceOnly", "targetOnly", "ambiguous"
KINDS = (MATCHED, SOURCE_ONLY, TARGET_ONLY)
#: Neighbours on each side whose costs are averaged to tell a match from an ambiguous one (fixed value).
CONTEXT = 2
_FAR = 1 << 50


@dataclass(frozen=True)
class EditRules:
    """``whole`` takes both sides from end to end; else the target's ends may stay outside the path."""

    open: int = 300
    extend: int = 60
    ambiguous: int = 700
    band_ms: int = 2_000
    whole: bool = True
    most_cells: int = 4_000_000


STEP_SCHEMA = "step bigint, kind string, source_start bigint, source_end bigint, target_start bigint, target_end bigint, cost bigint, total_cost bigint, fault string"


def costs_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Thousandths of one less the cosine, for all pairs of rows; 1000 where either has no length."""
    x, y = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    size = x[:, None] * y[None, :]
    none = (x <= np.finfo(float).eps)[:, None] | (y <= np.finfo(float).eps)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.floor(np.clip(1 - (a @ b.T) / size, 0, 2) * 1000 + 0.5)
    return np.where(none, 1000, out).astype(np.int64)


def _borders(at: np.ndarray) -> np.ndarray:
    """The frames' beginnings and the end of the last one, which is as long as the usual frame."""
    hop = np.sort(np.diff(at))[(len(at) - 1) // 2] if len(at) > 1 else 1
    return np.append(at, at[-1] + hop)


class _Row:
    """Costs of the three states for the targets [start, stop), and at target 0."""

    def __init__(self, start: int, states: np.ndarray, zero: tuple[int, int, int]):
        self.start, self.states, self.zero = start, states, zero

    def cut(self, start: int, stop: int) -> np.ndarray:
        out = np.full((3, stop - start), _FAR)
        a, b = max(start, self.start), min(stop, self.start + self.states.shape[1])
        if a < b:
            out[:, a - start : b - start] = self.states[:, a - self.start : b - self.start]
        if start == 0 < stop:
            out[:, 0] = self.zero
        return out


def align(at: np.ndarray, a: np.ndarray, bt: np.ndarray, b: np.ndarray, scale: float, offset: float, rules: EditRules) -> tuple[int | None, list[tuple], str | None]:
    """(total cost, steps (kind, source from, to, target from, to, cost), fault) of the cheapest path."""
    n, m = len(a), len(b)
    if not n or not m:
        return None, [], "empty"
    expected = scale * at + offset
    low = np.searchsorted(bt, np.ceil(expected - rules.band_ms), "left") + 1
    high = np.searchsorted(bt, np.floor(expected + rules.band_ms), "right") + 1
    if int((high - low).sum()) > rules.most_cells:
        return None, [], "cells"
    first = np.full((3, m + 1), _FAR)
    first[0, 0] = 0
    if rules.whole:
        first[2, 1:] = rules.open + rules.extend * np.arange(m)
    else:
        first[0, 1:] = 0
    row = _Row(0, first, tuple(first[:, 0]))
    came: list[np.ndarray] = []
    for i in range(n):
        start, stop = int(low[i]), int(high[i])
        zero = rules.open + rules.extend * i
        before = row.cut(start - 1, stop)
        both, up = before[:, :-1], before[:, 1:]
        now = np.full((3, stop - start), _FAR)
        parents = np.zeros((3, stop - start), np.uint8)
        if stop > start:
            parents[0] = both.argmin(axis=0)
            now[0] = both.min(axis=0) + costs_of(a[i : i + 1], b[start - 1 : stop - 1])[0]
            ways = np.stack([up[0] + rules.open, up[1] + rules.extend, up[2] + rules.open])
            parents[1], now[1] = ways.argmin(axis=0), ways.min(axis=0)
            # Only the target advances: the cheapest opening to the left, extended up to here.
            left = np.full((2, stop - start), _FAR)
            left[:, 1:] = now[:2, :-1]
            if start == 1:
                left[1, 0] = zero
            k = rules.extend * np.arange(stop - start)
            now[2] = np.minimum.accumulate(left.min(axis=0) + rules.open - k) + k
            on = np.append(_FAR, now[2, :-1]) + rules.extend
            parents[2] = np.stack([left[0] + rules.open, left[1] + rules.open, on]).argmin(axis=0)
            np.minimum(now, _FAR, out=now)
        came.append(parents)
        row = _Row(start, now, (_FAR, zero, _FAR))
    last = row.cut(0, m + 1)
    ends = range(m, m + 1) if rules.whole else range(m, -1, -1)
    total, _, j, state = min((int(last[s, j]), -j, j, s) for j in ends for s in range(3))
    if total >= _FAR:
        return None, [], "band"
    sb, tb = _borders(at), _borders(bt)
    i, steps = n, []
    while i > 0 or (rules.whole and j > 0):
        if i == 0:
            parent = 2 if j > 1 else 0
        elif j == 0:
            parent = 1 if i > 1 else 0
        else:
            parent = int(came[i - 1][state, j - int(low[i - 1])])
        s, t = int(state != 2), int(state != 1)
        cost = rules.extend
        kind = KINDS[state]
        if state == 0:
            back, ahead = min(CONTEXT, i - 1, j - 1), min(CONTEXT, n - i, m - j)
            around = [int(costs_of(a[i - 1 + o : i + o], b[j - 1 + o : j + o])[0, 0]) for o in range(-back, ahead + 1)]
            cost = (sum(around) + len(around) // 2) // len(around)
            kind = AMBIGUOUS if cost >= rules.ambiguous else MATCHED
        steps.append((kind, int(sb[i - s]), int(sb[i]), int(tb[j - t]), int(tb[j]), cost))
        i, j, state = i - s, j - t, parent
    return total, steps[::-1], None


def edit_steps(frames: DataFrame, pair: str = "pair_id", rules: EditRules = EditRules()) -> DataFrame:
    """The steps of every pair's path.

    ``frames`` is (pair, side 'source' or 'target', at_ms, values, scale, offset_ms): the target's clock is expected
    at scale * source + offset.  Pairs without a path have one row with a ``fault``: ``empty`` (a side without
    frames), ``cells`` (a band beyond the bound) or ``band`` (no path inside it).
    """
    kind = frames.schema[pair].dataType.simpleString()

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at_ms", kind="stable")
        a, b = (rows[rows["side"] == s] for s in ("source", "target"))
        values = [np.array(x["values"].tolist(), float) for x in (a, b)]
        total, steps, fault = align(a["at_ms"].to_numpy(np.int64), values[0], b["at_ms"].to_numpy(np.int64), values[1], float(rows["scale"].iloc[0]), float(rows["offset_ms"].iloc[0]), rules)
        out = pd.DataFrame(steps or [(None,) * 6], columns=["kind", "source_start", "source_end", "target_start", "target_end", "cost"])
        for name in ("source_start", "source_end", "target_start", "target_end", "cost"):
            out[name] = out[name].astype("Int64")
        out.insert(0, "step", np.arange(len(out)))
        out.insert(0, pair, rows[pair].iloc[0])
        out["total_cost"] = pd.array([total] * len(out), "Int64")
        out["fault"] = fault
        return out

    return frames.select(pair, "side", "at_ms", "values", "scale", "offset_ms").groupBy(pair).applyInPandas(solve, f"{pair} {kind}, {STEP_SCHEMA}")


def collapse_gaps(steps: DataFrame, pair: str = "pair_id") -> DataFrame:
    """``steps`` with every run of one-sided steps of both sides as one ambiguous step."""
    gap = F.col("kind").isin(SOURCE_ONLY, TARGET_ONLY)
    rows = runs(steps.withColumn("_gap", gap), [pair], ["step"], F.col("_gap"))
    w = W.partitionBy(pair, "run")
    both = F.col("_gap") & (F.max(F.col("kind") == SOURCE_ONLY).over(w)) & (F.max(F.col("kind") == TARGET_ONLY).over(w))
    rows = rows.withColumn("_both", both)
    rows = rows.withColumn("_at", F.when(F.col("_both"), F.min("step").over(w)).otherwise(F.col("step")))
    ends = [F.min("source_start").alias("source_start"), F.max("source_end").alias("source_end"), F.min("target_start").alias("target_start"), F.max("target_end").alias("target_end")]
    kind = F.when(F.first("_both"), AMBIGUOUS).otherwise(F.first("kind")).alias("kind")
    return rows.groupBy(pair, F.col("_at").alias("step")).agg(kind, *ends, F.sum("cost").alias("cost"))


def merge_steps(steps: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Spans of neighbouring steps of one kind that touch on both sides."""
    w = W.partitionBy(pair).orderBy("step")
    same = (F.lag("kind").over(w) == F.col("kind")) & (F.lag("source_end").over(w) == F.col("source_start")) & (F.lag("target_end").over(w) == F.col("target_start"))
    spans = steps.withColumn("_span", F.when(same, 0).otherwise(1)).withColumn("_span", F.sum("_span").over(w))
    out = spans.groupBy(pair, (F.col("_span") - 1).alias("span_index")).agg(F.first("kind").alias("kind"), F.min("source_start").alias("source_start"), F.max("source_end").alias("source_end"), F.min("target_start").alias("target_start"), F.max("target_end").alias("target_end"), F.count(F.lit(1)).alias("steps"))
    return out


def edit_spans(frames: DataFrame, pair: str = "pair_id", rules: EditRules = EditRules()) -> DataFrame:
    return merge_steps(collapse_gaps(edit_steps(frames, pair, rules).filter("fault IS NULL"), pair), pair)


def turned(frames: DataFrame) -> DataFrame:
    """``frames`` with the sides exchanged and the line inverted."""
    side = F.when(F.col("side") == "source", "target").otherwise("source")
    return frames.withColumns({"side": side, "offset_ms": F.round(-F.col("offset_ms") / F.col("scale")), "scale": 1 / F.col("scale")})


def two_way_spans(frames: DataFrame, pair: str = "pair_id", rules: EditRules = EditRules()) -> DataFrame:
    """Spans of the path whose one-sided ones the path from target to source confirms; the others become ambiguous.

    A one-sided span is confirmed by one of the same side, or an ambiguous one that is empty on the other, that covers
    half of it.  A way back of which more than a quarter is ambiguous decides nothing, nor does one without a path.
    ``demoted`` tells which spans have changed.  Only pairs with one-sided spans are aligned again.
    """
    there = edit_spans(frames, pair, rules).withColumn("edit", F.col("kind").isin(SOURCE_ONLY, TARGET_ONLY))
    again = frames.join(there.filter("edit").select(pair).distinct(), pair, "left_semi")
    kind = F.when(F.col("kind") == SOURCE_ONLY, TARGET_ONLY).when(F.col("kind") == TARGET_ONLY, SOURCE_ONLY).otherwise(F.col("kind"))
    back = edit_spans(turned(again), pair, rules).select(pair, kind.alias("b_kind"), F.col("target_start").alias("bs0"), F.col("target_end").alias("bs1"), F.col("source_start").alias("bt0"), F.col("source_end").alias("bt1"))
    longer = F.greatest(F.col("bs1") - F.col("bs0"), F.col("bt1") - F.col("bt0"))
    whole = F.greatest(F.max("bs1") - F.min("bs0"), F.max("bt1") - F.min("bt0"))
    unsure = F.coalesce(F.sum(F.when(F.col("b_kind") == AMBIGUOUS, longer)), F.lit(0))
    sure = back.groupBy(pair).agg(((whole > 0) & (unsure * 4 <= whole)).alias("sure")).filter("sure").select(pair, "sure")

    empty_source, empty_target = F.col("bs0") == F.col("bs1"), F.col("bt0") == F.col("bt1")
    shape = F.when(F.col("kind") == SOURCE_ONLY, (F.col("b_kind") == SOURCE_ONLY) | ((F.col("b_kind") == AMBIGUOUS) & empty_target & ~empty_source))
    shape = shape.otherwise((F.col("b_kind") == TARGET_ONLY) | ((F.col("b_kind") == AMBIGUOUS) & empty_source & ~empty_target))
    source_over = F.least("source_end", "bs1") - F.greatest("source_start", "bs0")
    target_over = F.least("target_end", "bt1") - F.greatest("target_start", "bt0")
    half = F.when(F.col("kind") == SOURCE_ONLY, source_over * 2 >= F.col("source_end") - F.col("source_start")).otherwise(target_over * 2 >= F.col("target_end") - F.col("target_start"))
    agreed = there.filter("edit").join(back, pair).filter(shape & half).select(pair, "span_index").distinct().withColumn("agreed", F.lit(True))
    out = there.join(sure, pair, "left").join(agreed, [pair, "span_index"], "left")
    demoted = F.col("edit") & F.col("sure").isNotNull() & F.col("agreed").isNull()
    return out.select(pair, "span_index", F.when(demoted, AMBIGUOUS).otherwise(F.col("kind")).alias("kind"), "source_start", "source_end", "target_start", "target_end", "steps", demoted.alias("demoted"))

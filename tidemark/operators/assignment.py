"""Matchings: events within a tolerance at least cost, and hypotheses that exclude each other.

Events can only meet inside a stretch in which neighbours are no further apart than the tolerance, so each stretch is
solved by itself and no task holds more than one.  Hypotheses are solved by the group they are given with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.groups import Group, columns, group_starts, solve_groups
from tidemark.session import cut, ship_package

#: How much the worst boundary weighs against the sum of all (fixed value).
WORST_WEIGHT = 16
#: Rows that are solved together, of a case that is read stretch by stretch, and cells of tables solved at once.
ROWS_TOGETHER, ROWS_HELD, CELLS = 50_000, 200_000, 4_000_000
#: Events of the smaller and the larger side of groups that are solved by their shape.
WIDEST, LONGEST = 6, 12
#: Cost of a pair that may not meet.
FAR = 1 << 60
#: Hypotheses of a group whose pairs are gone through one by one.
PLAIN = 24
SPAN = ("source_start", "source_end", "target_start", "target_end")


def cheapest_matching(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a matching with as many finite pairs as possible and, of these, the least total.

    Rows are added one by one along shortest augmenting paths under potentials (successive shortest paths); a row may
    also stay alone at a price above all others, so one more pair always outweighs the costs.
    """
    n, m = cost.shape
    if not n or not m or not np.isfinite(cost).any():
        return []
    if n == 1 or m == 1:
        row, column = np.unravel_index(int(cost.argmin()), cost.shape)
        return [(int(row), int(column))]
    alone = float(np.where(np.isfinite(cost), np.abs(cost), 0).sum()) * 2 + 1
    wide = np.full((n, m + n), np.inf)
    wide[:, :m] = cost
    wide[np.arange(n), m + np.arange(n)] = alone
    u, v = np.zeros(n), np.zeros(m + n)
    row_of = np.full(m + n, -1)
    for start in range(n):
        dist, back, done = np.full(m + n, np.inf), np.full(m + n, -1), np.zeros(m + n, bool)
        row, reached, last = start, 0.0, -1
        while True:
            step = reached + wide[row] - u[row] - v
            better = ~done & (step < dist)
            dist[better], back[better] = step[better], last
            last = int(np.where(done, np.inf, dist).argmin())
            reached = dist[last]
            done[last] = True
            if row_of[last] < 0:
                break
            row = row_of[last]
        u[start] += reached
        for j in np.flatnonzero(done):
            if j != last and row_of[j] >= 0:
                u[row_of[j]] += reached - dist[j]
            v[j] -= reached - dist[j]
        while last >= 0:
            before = back[last]
            row_of[last] = row_of[before] if before >= 0 else start
            last = before
    return sorted((int(row_of[j]), j) for j in range(m) if row_of[j] >= 0)


def boundary_errors(gold: np.ndarray, predicted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Worst and summed distance of the boundaries (source start, end, target start, end) of all pairs; ends count
    where either span is not empty on that side."""
    away = np.abs(gold[:, None, :] - predicted[None, :, :])
    for start, end in ((0, 1), (2, 3)):
        away[:, :, end] *= (gold[:, end] != gold[:, start])[:, None] | (predicted[:, end] != predicted[:, start])[None, :]
    return away.max(axis=2), away.sum(axis=2)


def _unique_matchings(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``cheapest_matching`` of many tables of one shape (k, rows, columns): the column of every row, -1 without one, and
    which tables have but one best matching.

    Sets of used columns are gone through row by row for all tables at once; costs are whole numbers, FAR where a pair
    may not meet.
    """
    k, n, m = cost.shape
    pair = np.where(cost < FAR, cost, 0).sum(axis=(1, 2)) + 1
    least, ways = np.full((k, 1 << m), FAR), np.zeros((k, 1 << m), np.int64)
    least[:, 0], ways[:, 0] = 0, 1
    sets, taken = np.arange(1 << m), np.full((n, k, 1 << m), -1, np.int8)
    for i in range(n):
        after, count = least.copy(), ways.copy()
        for j in range(m):
            having = sets[sets >> j & 1 == 1]
            before, price = least[:, having ^ 1 << j], cost[:, i, j, None]
            step = np.where((before < FAR) & (price < FAR), before + price - pair[:, None], FAR)
            held, n_held, more = after[:, having], count[:, having], ways[:, having ^ 1 << j]
            better = step < held
            count[:, having] = np.where(better, more, np.where((step == held) & (step < FAR), n_held + more, n_held))
            after[:, having] = np.where(better, step, held)
            taken[i][:, having] = np.where(better, j, taken[i][:, having])
        least, ways = after, count
    best = least.min(axis=1)
    one = np.where(least == best[:, None], ways, 0).sum(axis=1) == 1
    used, column = least.argmin(axis=1), np.empty((k, n), np.int64)
    for i in range(n - 1, -1, -1):
        column[:, i] = taken[i][np.arange(k), used]
        used = np.where(column[:, i] >= 0, used ^ (1 << np.maximum(column[:, i], 0)), used)
    return column, one


def _nearest(worst: np.ndarray, total: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of which the nearest meet one after the other."""
    i, j = (x.ravel() for x in np.indices(worst.shape))
    free_g, free_p, pairs = np.ones(len(worst), bool), np.ones(worst.shape[1], bool), []
    for k in np.lexsort((j, i, total.ravel(), worst.ravel())):
        if free_g[i[k]] and free_p[j[k]]:
            free_g[i[k]] = free_p[j[k]] = False
            pairs.append((int(i[k]), int(j[k])))
    return pairs


class _Events:
    """Rows of whole stretches in order of (case, start), solved for all groups of one shape at once."""

    def __init__(self, table: pa.Table, by: list[str], most_pairs: int):
        n = table.num_rows
        if any(table.column(c).null_count for c in (*SPAN, "limit")):
            raise ValueError("an event has no borders or no tolerance")
        self.spans = np.stack([table.column(c).to_numpy() for c in SPAN], axis=1).astype(np.int64)
        self.gold, self.limit = table.column("gold").to_numpy(zero_copy_only=False).astype(bool), table.column("limit").to_numpy().astype(np.int64)
        self.index = columns(table.select(["index"]))["index"]
        self.case = np.zeros(n, np.int64)
        self.case[group_starts(table, by)] = 1
        new = self.case == 1
        new[1:] |= np.diff(self.spans[:, 0]) > self.limit[1:]
        self.case, self.stretch = np.cumsum(self.case), np.cumsum(new)
        self.most_pairs = most_pairs
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]] = []
        self.used = np.zeros(n, bool)

    def solve(self, group: np.ndarray, within: bool, what: str) -> None:
        """Pairs of the rows not used yet, inside each value of ``group``, which ascends."""
        rows = np.flatnonzero(~self.used)
        place = np.unique(self.index[rows], return_inverse=True)[1]
        rows = rows[np.lexsort((place, ~self.gold[rows], group[rows]))]
        begin = np.flatnonzero(np.diff(group[rows], prepend=-1))
        size = np.diff(begin, append=len(rows))
        golds = np.add.reduceat(self.gold[rows].astype(np.int64), begin) if len(rows) else size
        others = size - golds
        for at in np.flatnonzero(golds * others > self.most_pairs)[:1]:
            raise ValueError(f"{what} has {golds[at]} x {others[at]} events")
        mixed = np.flatnonzero((golds > 0) & (others > 0))
        shapes, of = np.unique(golds[mixed] * (len(self.gold) + 1) + others[mixed], return_inverse=True)
        of_shape = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=len(shapes)))[:-1]) if len(shapes) else []
        for members in of_shape:
            held = mixed[members]
            n, m = int(golds[held[0]]), int(others[held[0]])
            each = max(1, CELLS // (n * m * (1 << min(n, m, WIDEST))))
            for k in range(0, len(held), each):
                first = begin[held[k : k + each]]
                g, p = rows[first[:, None] + np.arange(n)], rows[first[:, None] + n + np.arange(m)]
                self.meet(g, p, within)

    def meet(self, g: np.ndarray, p: np.ndarray, within: bool) -> None:
        away = np.abs(self.spans[g][:, :, None, :] - self.spans[p][:, None, :, :])
        long = np.stack([self.spans[:, 1] != self.spans[:, 0], self.spans[:, 3] != self.spans[:, 2]], axis=1)
        either = long[g][:, :, None, :] | long[p][:, None, :, :]
        away[..., 1] *= either[..., 0]
        away[..., 3] *= either[..., 1]
        worst, total = away.max(axis=3), away.sum(axis=3)
        (k, n, m), each = worst.shape, np.arange(len(g))
        if within:
            cost = np.where(worst <= self.limit[g][:, :1, None], worst * WORST_WEIGHT + total, FAR)
            if n == 1 or m == 1:
                at = cost.reshape(k, -1).argmin(axis=1)
                hit = np.flatnonzero(cost.reshape(k, -1)[each, at] < FAR)
                self.take(g, p, worst, total, hit, at[hit] // m, at[hit] % m, within)
                return
            by_hand = np.ones(k, bool)
            if min(n, m) <= WIDEST and max(n, m) <= LONGEST:
                turned = m > n
                column, one = _unique_matchings(cost.transpose(0, 2, 1) if turned else cost)
                by_hand = ~one
                t, x = np.nonzero((column >= 0) & one[:, None])
                y = column[t, x]
                self.take(g, p, worst, total, t, *((y, x) if turned else (x, y)), within)
            for t in np.flatnonzero(by_hand):
                found = cheapest_matching(np.where(cost[t] < FAR, cost[t], np.inf))
                if found:
                    i, j = np.array(found).T
                    self.take(g, p, worst, total, np.full(len(i), t), i, j, within)
        elif n * m > LONGEST * LONGEST or worst.max() >= 1 << 29:
            for t in range(k):
                i, j = np.array(_nearest(worst[t], total[t])).T
                self.take(g, p, worst, total, np.full(len(i), t), i, j, within)
        else:
            open_ = (worst << 32) + total
            for _ in range(min(n, m)):
                at = open_.reshape(k, -1).argmin(axis=1)
                i, j = at // m, at % m
                self.take(g, p, worst, total, each, i, j, within)
                open_[each, i, :] = FAR
                open_[each, :, j] = FAR

    def take(self, g: np.ndarray, p: np.ndarray, worst: np.ndarray, total: np.ndarray, t: np.ndarray, i: np.ndarray, j: np.ndarray, within: bool) -> None:
        a, b = g[t, i], p[t, j]
        self.used[a] = self.used[b] = True
        self.pairs.append((a, b, worst[t, i, j], total[t, i, j], within))


def match_events(gold: DataFrame, predicted: DataFrame, by: list[str], tolerance: int | str, most_pairs: int = 4_000_000) -> DataFrame:
    """(by, gold_index, predicted_index, worst_ms, sum_ms, within): which event stands for which.

    Events are (by, index, source_start, source_end, target_start, target_end).  Inside ``tolerance`` as many events
    as possible meet, at the least total of 16 x worst + sum of boundary errors; of what is left the nearest meet
    one after the other and are not ``within``.  ``tolerance`` may name a column of both that is one number for a key.

    Cases are read in order, many at a time; one of more than ROWS_HELD events is read stretch by stretch, and what is
    left of it is solved afterwards.
    """
    limit = F.lit(tolerance) if isinstance(tolerance, int) else F.col(tolerance)
    both = gold.select(*by, "index", *SPAN, F.lit(True).alias("gold"), limit.alias("limit")).unionByName(predicted.select(*by, "index", *SPAN, F.lit(False).alias("gold"), limit.alias("limit")))
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    made = StructType.fromDDL(", ".join([*(f"`{c}` {kinds[c]}" for c in by), f"gold_index {kinds['index']}", f"predicted_index {kinds['index']}", "worst_ms bigint, sum_ms bigint, within boolean", *(f"{c} bigint" for c in (*SPAN, "`limit`"))]))
    names = made.names

    def solved(table: pa.Table, whole: bool) -> pa.RecordBatch:
        events = _Events(table, by, most_pairs)
        events.solve(events.stretch, True, "a stretch that the tolerance joins")
        if whole:
            events.solve(events.case, False, "what is left of a case")
        none = np.empty(0, np.int64)
        a, b, worst, total = (np.concatenate([none, *(x[k] for x in events.pairs)]) for k in range(4))
        within = np.concatenate([np.empty(0, bool), *(np.full(len(x[0]), x[4]) for x in events.pairs)])
        left = none if whole else np.flatnonzero(~events.used)
        met, nulls = len(a), lambda n: np.ones(n, bool)
        index = table.column("index").combine_chunks()
        rows = pa.array(np.concatenate([a, left]))
        blank = np.concatenate([np.zeros(met, bool), nulls(len(left))])
        pad = np.zeros(len(left), np.int64)
        mine = lambda side, x: pa.array(np.concatenate([x, left]), mask=np.concatenate([np.zeros(met, bool), events.gold[left] != side]))
        arrays = [*(table.column(c).combine_chunks().take(rows) for c in by), index.take(mine(True, a)), index.take(mine(False, b)), pa.array(np.concatenate([worst, pad]), mask=blank), pa.array(np.concatenate([total, pad]), mask=blank), pa.array(np.concatenate([within, pad.astype(bool)]), mask=blank)]
        arrays += [pa.array(np.concatenate([np.zeros(met, np.int64), x[left]]), mask=~blank) for x in (*events.spans.T, events.limit)]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        count, enough, going_on = 0, ROWS_TOGETHER, False  # does the case at the front go on from rows solved before?
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            count += batch.num_rows
            if count < enough:
                continue
            table = pa.concat_tables(held).combine_chunks()
            cases = group_starts(table, by)
            if going_on and len(cases):
                yield solved(table.slice(0, cases[0]), False)
                table, cases, going_on = table.slice(cases[0]), cases[1:] - cases[0], False
            if len(cases):
                yield solved(table.slice(0, cases[-1]), True)
                table = table.slice(cases[-1])
            if table.num_rows > ROWS_HELD:
                last = np.flatnonzero(np.diff(_Events(table, by, most_pairs).stretch))
                if len(last):
                    yield solved(table.slice(0, last[-1] + 1), False)
                    table, going_on = table.slice(last[-1] + 1), True
            held, count = [table], table.num_rows
            enough = max(ROWS_TOGETHER, 2 * count)
        if count:
            table = pa.concat_tables(held).combine_chunks()
            cases = group_starts(table, by) if going_on else []
            if going_on:
                first = cases[0] if len(cases) else table.num_rows
                yield solved(table.slice(0, first), False)
                table = table.slice(first)
            yield solved(table, True)

    ship_package(both.sparkSession)
    found = cut(both.repartition(*by).sortWithinPartitions(*by, "source_start", "gold", "index").mapInArrow(run, made))
    near = found.filter("within IS NOT NULL").select(*names[:-5])
    open_ = found.filter("within IS NULL")
    if not open_.limit(1).count():
        return near
    left = open_.select(*by, F.coalesce("gold_index", "predicted_index").alias("index"), *SPAN, F.col("gold_index").isNotNull().alias("gold"))

    def solve(rows: Group) -> list[tuple]:
        g, p = np.flatnonzero(rows["gold"]), np.flatnonzero(~rows["gold"].astype(bool))
        if len(g) * len(p) > most_pairs:
            raise ValueError(f"what is left of a case has {len(g)} x {len(p)} events")
        spans = np.stack([rows[c] for c in SPAN], axis=1).astype(np.int64)
        worst, total = boundary_errors(spans[g], spans[p])
        key, index = tuple(rows[c][0] for c in by), rows["index"]
        return [(*key, index[g[i]], index[p[j]], worst[i, j], total[i, j], False) for i, j in _nearest(worst, total)]

    sides = left.groupBy(*by).agg(F.bool_or("gold").alias("a"), F.bool_and("gold").alias("b")).filter("a AND NOT b").select(*by)
    return near.unionByName(solve_groups(left.join(sides, by, "left_semi"), by, ["index"], solve, StructType(made.fields[:-5]).toDDL()))


def event_counts(gold: DataFrame, predicted: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """(by, tp, fp, fn): matches within the tolerance, predicted events without one, and gold events without one."""
    n = lambda rows, name: rows.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    out = n(gold, "_g").join(n(predicted, "_p"), by, "full").join(n(matches.filter("within"), "_m"), by, "left")
    g, p, m = (F.coalesce(c, F.lit(0)) for c in ("_g", "_p", "_m"))
    return out.select(*by, m.alias("tp"), (p - m).alias("fp"), (g - m).alias("fn"))


@dataclass(frozen=True)
class ChoiceRules:
    overlap_ms: int = 250
    inversion: float = 0.08
    repeated: float = 0.3
    exact_up_to: int = 18
    beam: int = 256
    ambiguous_under: float = 0.08


def hypothesis_weight(score: Column, unique: Column, lead: Column, repeated: Column, rules: ChoiceRules = ChoiceRules()) -> Column:
    """What a hypothesis is worth by itself."""
    return score * (F.lit(0.35) + unique * 0.65) + lead * 0.2 - F.when(repeated, rules.repeated).otherwise(0.0)


class _Choices:
    """Hypotheses in order of worth, with bit sets of those that exclude each other and the prices of inversions."""

    def __init__(self, a: dict[str, list], rules: ChoiceRules):
        n = len(a["id"])
        self.ids, self.worth = a["id"], a["worth"]
        self.price = rules.inversion
        self.alternative, self.source_over, self.target_over, self.inverted = (self._plain if n <= PLAIN else self._broad)(a, rules.overlap_ms)
        self.excluded = [x | y | z for x, y, z in zip(self.alternative, self.source_over, self.target_over, strict=True)]

    @staticmethod
    def _plain(a: dict[str, list], overlap: int) -> tuple[list[int], ...]:
        """Bit sets of a small group, pair by pair."""
        n = len(a["id"])
        out = alternative, source_over, target_over, inverted = [0] * n, [0] * n, [0] * n, [0] * n
        told = a["alternative"]
        sides = []
        for side, over, hint in (("source", source_over, "target_order"), ("target", target_over, "source_order")):
            sides.append((a[side], a[f"{side}_start"], a[f"{side}_end"], a[hint], over))
        for i in range(1, n):
            for j in range(i):
                if told[i] is not None and told[i] == told[j]:
                    alternative[i] |= 1 << j
                    alternative[j] |= 1 << i
                turned = False
                for shared, start, end, hint, over in sides:
                    if shared[i] != shared[j]:
                        continue
                    if min(end[i], end[j]) - max(start[i], start[j]) > overlap:
                        over[i] |= 1 << j
                        over[j] |= 1 << i
                    x, y = hint[i], hint[j]
                    if x is not None and y is not None:
                        turned |= (start[i] < start[j] and x > y) or (start[i] > start[j] and x < y)
                if turned:
                    inverted[i] |= 1 << j
                    inverted[j] |= 1 << i
        return out

    @staticmethod
    def _broad(a: dict[str, list], overlap: int) -> tuple[list[int], ...]:
        """The same of a large group, by tables of all pairs."""
        named = {c: np.fromiter(a[c], object, len(a[c])) for c in ("source", "target", "alternative")}
        at = {f"{c}_{end}": np.array(a[f"{c}_{end}"]) for c in ("source", "target") for end in ("start", "end")}
        same = {c: named[c][:, None] == named[c] for c in ("source", "target")}
        told = np.array([x is not None for x in a["alternative"]], bool)
        alternative = (named["alternative"][:, None] == named["alternative"]) & told[:, None] & told

        def over(c: str) -> np.ndarray:
            s, e = at[f"{c}_start"], at[f"{c}_end"]
            return same[c] & (np.minimum(e[:, None], e) - np.maximum(s[:, None], s) > overlap)

        def inverted(shared: str, hint: str) -> np.ndarray:
            h, start = np.array(a[hint], float), at[f"{shared}_start"]
            turn = np.sign(start[:, None] - start) * np.sign(h[:, None] - h)
            return same[shared] & (np.nan_to_num(turn) < 0)

        tables = alternative, over("source"), over("target"), inverted("source", "target_order") | inverted("target", "source_order")
        return tuple([sum(1 << int(j) for j in np.flatnonzero(row)) for row in table] for table in tables)

    def gain(self, k: int, chosen: int) -> float | None:
        """What adding ``k`` brings, if it may be added and brings anything."""
        if chosen & self.excluded[k]:
            return None
        gain = self.worth[k] - (chosen & self.inverted[k]).bit_count() * self.price
        return gain if gain > 0 else None

    def names(self, chosen: int) -> list:
        return sorted(x for k, x in enumerate(self.ids) if chosen >> k & 1)

    def best(self, other_than: int | None = None) -> tuple[float, int] | None:
        """The best choice by depth-first search; with ``other_than``, the best that holds something else too."""
        n = len(self.ids)
        rest = [*accumulate((max(x, 0) for x in reversed(self.worth)), initial=0.0)][::-1]
        found: tuple[float, list, int] | None = None
        todo = [(0, 0, 0.0)]
        while todo:
            k, chosen, score = todo.pop()
            if found and score + rest[k] < -found[0]:
                continue
            if k == n:
                if (other_than is None or chosen & ~other_than) and not (found and -score > found[0]):
                    key = (-score, self.names(chosen), chosen)
                    found = min(found, key) if found else key
                continue
            todo.append((k + 1, chosen, score))
            gain = self.gain(k, chosen)
            if gain is not None:
                todo.append((k + 1, chosen | 1 << k, score + gain))
        return (-found[0], found[2]) if found else None

    def beam(self, width: int, other_than: int | None = None) -> tuple[float, int] | None:
        """The best of the ``width`` best partial choices; with ``other_than``, half of them hold something else."""
        states = {0: 0.0}
        order = lambda x: (-x[1], self.names(x[0]))
        for k in range(len(self.ids)):
            after = dict(states)
            for chosen, score in states.items():
                gain = self.gain(k, chosen)
                if gain is not None:
                    after[chosen | 1 << k] = max(score + gain, after.get(chosen | 1 << k, -np.inf))
            if other_than is None:
                states = dict(sorted(after.items(), key=order)[:width])
            else:
                parts = ([x for x in after.items() if bool(x[0] & ~other_than) == other] for other in (False, True))
                states = dict(x for part in parts for x in sorted(part, key=order)[: max(1, width // 2)])
        ends = [x for x in states.items() if other_than is None or x[0] & ~other_than]
        if not ends:
            return None
        chosen, score = min(ends, key=order)
        return score, chosen


def choose(hypotheses: DataFrame, group: str = "group_id", rules: ChoiceRules = ChoiceRules()) -> DataFrame:
    """Per hypothesis whether it is in the best combination of its group and in the runner-up, and why not.

    ``hypotheses`` is (group, id, worth, source, target, source_start, source_end, target_start, target_end,
    alternative, source_order, target_order, blocked).  Two exclude each other if they share an alternative or
    overlap on a shared source or target; an order against the hints costs ``inversion`` for each pair.  The
    runner-up must hold something that the best does not.  Groups of up to ``exact_up_to`` are searched whole, larger
    ones with a beam; if that finds a better runner-up it becomes the best.  ``reason`` is blocked,
    samePairAlternative, sourceOverlap, targetOverlap or notInBestCombination.
    """
    kinds = {f.name: f.dataType.simpleString() for f in hypotheses.schema}
    schema = f"`{group}` {kinds[group]}, id {kinds['id']}, selected boolean, runner_up boolean, reason string, conflicts array<{kinds['id']}>, score double, runner_up_score double, margin double, ambiguous boolean, exact boolean"

    def solve(rows: Group) -> list[tuple]:
        all_ = {c: x.tolist() for c, x in rows.items()}
        order = sorted(range(len(all_["id"])), key=lambda k: (-all_["worth"][k], all_["id"][k]))
        blocked = [bool(all_["blocked"][k]) for k in order]
        open_order = [k for k, b in zip(order, blocked, strict=True) if not b]
        free = _Choices({c: [x[k] for k in open_order] for c, x in all_.items()}, rules)
        exact = len(free.ids) <= rules.exact_up_to
        search = free.best if exact else lambda *other: free.beam(rules.beam, *other)
        best = search() or (0.0, 0)
        second = search(best[1])
        if not exact and second and second[0] > best[0]:
            best = second
            second = search(best[1])
        margin = max(0.0, best[0] - second[0]) / max(abs(best[0]), 1e-9) if second else 1.0 if best[1] and exact else None
        open_ = any(w > 0 and not best[1] >> k & 1 for k, w in enumerate(free.worth))
        ambiguous = (not exact and open_ and second is None) or (second is not None and margin < rules.ambiguous_under)
        place = {x: k for k, x in enumerate(free.ids)}
        out = []
        for x, b in zip((all_["id"][k] for k in order), blocked, strict=True):
            k = place.get(x)
            selected = k is not None and bool(best[1] >> k & 1)
            reason, conflicts = None, []
            if b:
                reason = "blocked"
            elif not selected:
                reason = "notInBestCombination"
                for name, met in (("samePairAlternative", free.alternative), ("sourceOverlap", free.source_over), ("targetOverlap", free.target_over)):
                    conflicts = free.names(met[k] & best[1])
                    if conflicts:
                        reason = name
                        break
            out.append((all_[group][0], x, selected, k is not None and second is not None and bool(second[1] >> k & 1), reason, conflicts, best[0], second[0] if second else None, margin, ambiguous, exact))
        return out

    return solve_groups(hypotheses, [group], ["id"], solve, schema)

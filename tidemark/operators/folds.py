"""Ordered folds per key: what happens at a row may depend on everything before it, through a small state."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.operators.groups import ROWS_OUT
from tidemark.session import fresh, ship_package

Step = Callable[[Any, dict], tuple[Any, Iterable[tuple]]]


def fold(rows: DataFrame, by: list[str], order: list[str], step: Step, schema: str, last: Callable[[Any], Iterable[tuple]] | None = None, border: Column | None = None) -> DataFrame:
    """What ``step(state, row)`` emits, row by row of a key in ``order``, and at its end ``last(state)``.

    ``step`` gives the next state (None at first) and rows of ``schema``; the key stands before them.  A task reads
    its keys from Arrow batches and holds a state and a batch, never a key's rows, so keys may be of any length.
    ``border`` marks rows before which a key may be cut, because the fold begins anew there: its pieces then go to
    different tasks.
    """
    ship_package(rows.sparkSession)
    (piece,) = fresh(rows, "_piece")
    keys = [*by]
    if border is not None:
        counted = F.sum(F.when(border, 1).otherwise(0)).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
        rows, keys = rows.withColumn(piece, counted), [*by, piece]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    made = StructType.fromDDL(", ".join([*(f"`{c}` {kinds[c]}" for c in by), schema]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(made)
        state, open_, began = None, None, False
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            parts = list(zip(*out, strict=True)) if out else [()] * len(made.names)
            return pa.RecordBatch.from_arrays([pa.array(p, types.field(k).type) for k, p in enumerate(parts)], made.names)

        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[c] for c in keys)
                if not began or key != open_:
                    if began and last:
                        out.extend((*open_[: len(by)], *x) for x in last(state))
                    state, open_, began = None, key, True
                state, found = step(state, row)
                out.extend((*key[: len(by)], *x) for x in found)
            if len(out) >= ROWS_OUT:
                yield packed()
                out = []
        if began and last:
            out.extend((*open_[: len(by)], *x) for x in last(state))
        yield packed()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, made)


def merge_near(cuts: DataFrame, by: list[str], at: str, gap: str, confidence: str, start: str, end: str, within: int = 2_000) -> DataFrame:
    """Cuts joined to the first cut of their group as long as they are ``within`` of it, which no session window tells:
    a session grows with every row, a group does not.

    Gaps add up, the least confidence counts, and the range covers all; the place is the first cut's.  Where a cut is
    further than ``within`` from the one before, a group begins whatever came earlier, so keys are cut there.
    """
    a, b = F.coalesce(start, at), F.coalesce(end, at)
    rows = cuts.select(*by, F.col(at).alias("at"), F.col(gap).alias("gap"), F.col(confidence).alias("confidence"), a.alias("a"), b.alias("b"))
    away = F.col("at") - F.lag("at").over(W.partitionBy(*by).orderBy("at", "gap", "confidence", "a", "b"))

    def step(state: list | None, row: dict) -> tuple[list, list[tuple]]:
        if state is None or abs(row["at"] - state[0]) > within:
            return [row["at"], row["gap"], row["confidence"], row["a"], row["b"], 1], [tuple(state)] if state else []
        return [state[0], state[1] + row["gap"], min(state[2], row["confidence"]), min(state[3], row["a"]), max(state[4], row["b"]), state[5] + 1], []

    kind = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    schema = f"{at} {kind['at']}, {gap} {kind['gap']}, {confidence} {kind['confidence']}, range_start {kind['a']}, range_end {kind['b']}, merged bigint"
    return fold(rows.withColumn("_far", F.coalesce(away > within, F.lit(True))), by, ["at", "gap", "confidence", "a", "b"], step, schema, last=lambda s: [tuple(s)], border=F.col("_far"))


#: Observations that make an offset stable, how many times as many are looked at, and the share that must agree (fixed
#: values).
STABLE, AHEAD, AGREEING = 5, 3, 0.7


def held_offsets(observations: DataFrame, by: list[str], at: str, offset: str, least: int, step: int, out: str = "held") -> DataFrame:
    """``observations`` with the offset in force: it rises only by ``least`` or more, and only where enough of the
    following observations agree with the rise; it never falls.

    Offsets are rounded to ``step``.  How many of the next STABLE x AHEAD agree is a window of fixed length; only the
    offset in force is carried along.
    """
    rounded = (F.floor(F.col(offset) / step + F.lit(0.5)) * step).cast("long")
    rows = observations.withColumn("_o", rounded)
    w = W.partitionBy(*by).orderBy(at, offset)
    ahead = F.collect_list("_o").over(w.rowsBetween(0, STABLE * AHEAD - 1))
    size = F.size(ahead)
    agree = F.size(F.filter(ahead, lambda x: F.abs(x - F.col("_o")) <= step))
    needed = F.greatest(F.least(F.lit(STABLE), size), F.ceil(size * F.lit(AGREEING)))
    rows = rows.withColumn("_stable", agree >= needed)

    def carry(state: int | None, row: dict) -> tuple[int, list[tuple]]:
        if state is None or (row["_o"] - state >= least and row["_stable"]):
            state = row["_o"]
        return state, [(row[at], row[offset], state)]

    kind = {c: rows.schema[c].dataType.simpleString() for c in (at, offset)}
    return fold(rows.select(*by, at, offset, "_o", "_stable"), by, [at, offset], carry, f"`{at}` {kind[at]}, `{offset}` {kind[offset]}, `{out}` bigint")

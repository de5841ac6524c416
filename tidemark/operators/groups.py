"""Ordered groups of rows, solved many to a task without a call of Spark's for each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.session import ship_package

#: Rows of a result handed over together.
ROWS_OUT = 20_000

Group = dict[str, np.ndarray]


def columns(table: pa.Table) -> Group:
    """Columns as arrays; nulls are None, and columns with nulls, texts and lists are arrays of objects."""
    out = {}
    for name in table.column_names:
        column = table.column(name).combine_chunks()
        plain = column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_boolean(column.type))
        if plain:
            out[name] = column.to_numpy(zero_copy_only=False)
        else:
            values = np.empty(len(column), object)
            values[:] = column.to_pylist()
            out[name] = values
    return out


def group_starts(table: pa.Table, by: list[str]) -> np.ndarray:
    """Where a row's key differs from the one before."""
    changed = np.zeros(max(table.num_rows - 1, 0), bool)
    for name in by:
        codes = pc.dictionary_encode(table.column(name).combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        changed |= codes[1:] != codes[:-1]
    return np.flatnonzero(changed) + 1


def each_group(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[Group]:
    """The groups of batches that come in order of ``by``; a group may go over any number of batches."""
    open_: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if open_:  # does the batch go on with the open group?
            seam = pa.concat_tables([open_[-1].slice(open_[-1].num_rows - 1), table.slice(0, 1)])
            if len(group_starts(seam, by)):
                yield columns(pa.concat_tables(open_))
                open_ = []
        starts = group_starts(table, by).tolist()
        if not starts:
            open_.append(table)
            continue
        if open_:
            yield columns(pa.concat_tables([*open_, table.slice(0, starts[0])]))
        else:
            starts = [0, *starts]
        inner = columns(table.slice(starts[0], starts[-1] - starts[0]))
        for a, b in zip(starts, starts[1:]):
            yield {name: x[a - starts[0] : b - starts[0]] for name, x in inner.items()}
        open_ = [table.slice(starts[-1])]
    if open_:
        yield columns(pa.concat_tables(open_))


def each_table(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """``each_group`` as tables, for groups of few batches."""
    open_: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([open_, table]) if open_ else table
        starts = [0, *group_starts(table, by).tolist()]
        for a, b in zip(starts, starts[1:]):
            yield table.slice(a, b - a)
        open_ = table.slice(starts[-1])
    if open_:
        yield open_


def solve_groups(rows: DataFrame, by: list[str], order: list[str], solve: Callable[[Group], Iterable[tuple]], schema: str) -> DataFrame:
    """What ``solve`` gives for every group of equal ``by``, with the group's rows in ``order``.

    Groups are dealt by their key and sorted by Spark; a task takes one after the other from Arrow batches and holds
    one at a time, so a group must be bounded, and any number of small ones costs little more than their rows.
    """
    ship_package(rows.sparkSession)
    made = StructType.fromDDL(schema)
    names = made.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(made)
        found: list[tuple] = []

        def packed() -> pa.RecordBatch:
            parts = list(zip(*found, strict=True)) if found else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(p, kinds.field(k).type, from_pandas=True) for k, p in enumerate(parts)], names)

        for group in each_group(batches, by):
            found.extend(solve(group))
            if len(found) >= ROWS_OUT:
                yield packed()
                found = []
        yield packed()

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, made)

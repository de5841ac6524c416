"""Positions of rows in an order, and sums up to them, from ranges of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut, fresh


def running(rows: DataFrame, by: list[str], *order: Column | str, value: str, total: str) -> DataFrame:
    """``rows`` with ``total``, the sum of ``value`` over the rows of equal ``by`` up to each in ``order``.

    Rows are dealt by ranges of (by, order), so one value of ``by`` may hold any share of them; what comes before a
    range is summed from one row for each range and value of ``by``.  The rows are written once in their order, as
    ranges drawn again would differ.  Nulls are values of their own; the order of equal rows is arbitrary.
    """
    at, part, inner, before = fresh(rows, "at", "part", "inner", "before")
    placed = cut(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn(at, F.monotonically_increasing_id()))
    placed = placed.withColumn(part, F.shiftright(at, 33))
    pieces = placed.groupBy(part, *by).agg(F.sum(value).alias(inner))
    sofar = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn(before, F.coalesce(F.sum(inner).over(sofar), F.lit(0)))
    pieces = pieces.select(F.col(part).alias(inner), *(F.col(c).alias(f"{before}{k}") for k, c in enumerate(by)), before)
    here = F.sum(value).over(Window.partitionBy(part, *by).orderBy(at))
    return placed.withColumn(total, here).join(pieces, _same(by, part, inner, before)).select(*rows.columns, (F.col(total) + F.col(before)).alias(total))


def _same(by: list[str], part: str, of: str, name: str) -> Column:
    same = F.col(part) == F.col(of)
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"{name}{k}"))
    return same


def numbered(rows: DataFrame, by: list[str], *order: Column | str, pos: str = "pos") -> DataFrame:
    """``rows`` with ``pos``, from 0 on, the place of each among the rows of equal ``by`` in ``order``.

    Rows are dealt by ranges of (by, order), so one value of ``by`` may hold any share of them; the number of rows
    before a range is summed from one row for each range and value.  The rows are written once in their order, as
    ranges drawn again would differ.  Nulls are values of their own; the order of equal rows is arbitrary.
    """
    at, part, first, n, before = fresh(rows, "at", "part", "first", "n", "before")
    placed = cut(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn(at, F.monotonically_increasing_id()))
    placed = placed.withColumn(part, F.shiftright(at, 33))
    pieces = placed.groupBy(part, *by).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
    sofar = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn(before, F.coalesce(F.sum(n).over(sofar), F.lit(0)) - F.col(first))
    pieces = pieces.select(F.col(part).alias(n), *(F.col(c).alias(f"{before}{k}") for k, c in enumerate(by)), before)
    return placed.join(pieces, _same(by, part, n, before)).select(*rows.columns, (F.col(at) + F.col(before)).alias(pos))

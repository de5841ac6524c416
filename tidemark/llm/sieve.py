"""A bit filter that keeps most unwanted rows from being shuffled before an exact join drops the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import fresh

#: Bits for each wanted key, and bits at most (32 MiB, from 16 million keys on; beyond, more rows pass).
BITS_EACH, SIEVE_BITS = 16, 1 << 28


def sieved(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` whose long ``key`` may be in the one column of ``wanted``; none that is there is lost.

    ``wanted`` is read twice, so it should be a table.
    """
    (name,) = wanted.columns
    count = wanted.count()
    words = min(SIEVE_BITS, 1 << max(10, (count * BITS_EACH - 1).bit_length())) // 64
    word, bits = fresh(rows, "sieve_word", "sieve_bits")

    def place(value: str) -> tuple:
        h = F.xxhash64(F.col(value).cast("long"))
        return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(words - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))

    at, bit = place(name)
    table = wanted.filter(F.col(name).isNotNull()).select(at.alias(word), bit.alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    at, bit = place(key)
    met = rows.withColumn(word, at).join(F.broadcast(table), word).filter(F.col(bits).bitwiseAND(bit) != 0)
    return met.select(*(F.col(f"`{c}`") for c in rows.columns))

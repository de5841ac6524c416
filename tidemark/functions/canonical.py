"""JSON text whose bytes depend on the values only, and digests of it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, MapType, NullType, StringType, StructType, TimestampNTZType, TimestampType

#: Characters that JSON writes in a short form (fixed values).
SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def quoted(text: Column) -> Column:
    """A JSON string; control characters without a short form as four lower-case hexadecimal digits."""
    out = text
    for raw, short in SHORT.items():
        out = F.replace(out, F.lit(raw), F.lit(short))
    rest = [chr(k) for k in range(32) if chr(k) not in SHORT]
    marks = F.transform(F.split(out, ""), lambda c: F.when(c.isin(*rest), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c).cast("long"))), 4, "0"))).otherwise(c))
    return F.concat(F.lit('"'), F.when(out.rlike("[\\x00-\\x1f]"), F.array_join(marks, "")).otherwise(out), F.lit('"'))


def number(value: Column) -> Column:
    """A double in its shortest form as scripts write it: whole below 1e21 without a point, exponents from 1e21 on and
    below 1e-6; anything that is no number is null."""
    text = value.cast("string")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)", 1), r"\.0$", ""), r"\.", "")
    dot = F.instr(F.concat(F.regexp_extract(text, r"^-?([0-9.]+)", 1), F.lit(".")), ".") - 1
    exponent = F.coalesce(F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    lead = F.length(F.regexp_extract(digits, "^(0*)", 1))
    bare = F.regexp_replace(F.regexp_replace(digits, "^0+", ""), "0+$", "")
    point = dot + exponent - lead  # the value is 0.bare x 10 ** point
    n = F.length(bare)
    plain = (
        F.when((point >= n) & (point <= 21), F.rpad(bare, point, "0"))
        .when((point > 0) & (point <= 21), F.concat(F.substr(bare, F.lit(1), point), F.lit("."), F.substr(bare, point + 1)))
        .when((point > -6) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), bare))
    )
    power = point - 1
    scientific = F.concat(F.substr(bare, F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(bare, F.lit(2)))).otherwise(""), F.lit("e"), F.when(power >= 0, "+").otherwise(""), power.cast("string"))
    sign = F.when(value < 0, "-").otherwise("")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit("null")).when(value == 0, F.lit("0")).otherwise(F.concat(sign, F.coalesce(plain, scientific)))


def json_of(value: Column, kind: DataType, ordered: bool = True) -> Column:
    """``value`` of type ``kind`` as JSON without blanks.

    Names of a structure come in the order of their characters, or with ``ordered`` off in the structure's own; entries
    of a map by their keys.  Nulls are written as null.
    """
    if isinstance(kind, StructType):
        names = sorted(kind.names) if ordered else kind.names
        parts = [F.concat(quoted(F.lit(n)), F.lit(":"), json_of(value.getField(n), kind[n].dataType, ordered)) for n in names]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_of(x, kind.elementType, ordered)), ","), F.lit("]"))
    elif isinstance(kind, MapType):
        entries = F.array_sort(F.map_entries(F.transform_keys(value, lambda k, _: k.cast("string"))))
        text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), json_of(e["value"], kind.valueType, ordered))), ","), F.lit("}"))
    elif isinstance(kind, (DoubleType, FloatType)):
        text = number(value.cast("double"))
    elif isinstance(kind, (IntegralType, BooleanType, DecimalType)):
        text = value.cast("string")
    elif isinstance(kind, NullType):
        return F.lit("null")
    elif isinstance(kind, (StringType, DateType, TimestampType, TimestampNTZType)):
        text = quoted(value.cast("string"))
    else:
        raise TypeError(f"no JSON for {kind.simpleString()}")
    return F.when(value.isNotNull(), text).otherwise("null")


def json_array(parts: Iterable[Column]) -> Column:
    """A JSON array of values that are JSON already."""
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def digest(text: Column, prefix: str = "sha256:") -> Column:
    """SHA-256 of the text's UTF-8 bytes in lower-case hexadecimal digits."""
    return F.concat(F.lit(prefix), F.sha2(text, 256))

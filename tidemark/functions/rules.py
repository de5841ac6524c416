"""Rule texts: episode durations, cut points, anchors, and the numbers in them.

Every parser reads a whole text into an array of its entries in order; an entry that cannot be read keeps its text and
has nulls, so what was wrong is known and nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.session import once

#: Blanks, as the formats' own parsers understand them (fixed values).
BLANKS = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: What stands between cut points (fixed values).
CUT_SIGNS = "[\n,，;；]+"
#: What stands between the two times of an anchor (fixed values).
ANCHOR_SIGNS = rf"[{BLANKS}]*(?:->|=>|→|,|，|\t)[{BLANKS}]*"
#: Units of a number that counts minutes (fixed values).
MINUTES = "(?:分钟|分|min|m)"
#: Forms of a duration at the end of a line, and of the season and episode before it (fixed values).
DURATION = rf"[0-9]+(?::[0-9]{{1,2}}){{1,2}}(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?[{BLANKS}]*{MINUTES}?"
SEASON_EPISODE = "(?i)S([0-9]{1,2})E([0-9]{1,3})"
SEASON_EPISODE_CJK = "第?([0-9]{1,2})季第?([0-9]{1,3})(?:集|话|話)?"
EPISODE_LAST = r"(?i)(?:E|第)?([0-9]{1,3})(?:集|话|話)?\z"
DECIMAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def stripped(text: Column) -> Column:
    """``text`` without blanks of any kind at its ends."""
    return F.regexp_replace(text, rf"\A[{BLANKS}]+|[{BLANKS}]+\z", "")


def number(text: Column) -> Column:
    """A decimal, exponent, hexadecimal, octal or binary number; blank text is 0, anything else or beyond range null."""

    def read(t: Column) -> Column:
        def based(sign: str, digits: str, base: int) -> Column:
            return F.when(t.rlike(f"^0[{sign}][{digits}]+$"), F.conv(F.substr(t, F.lit(3)), base, 10).try_cast("double"))

        value = F.when(t.rlike(rf"^{DECIMAL}\z"), t.try_cast("double"))
        found = F.coalesce(F.when(t == "", F.lit(0.0)), value, based("xX", "0-9a-fA-F", 16), based("oO", "0-7", 8), based("bB", "01", 2))
        return F.when(F.abs(found) < float("inf"), found)

    return once(stripped(text), read)


def whole_number(text: Column) -> Column:
    """The whole part of a number in a text; null for blank texts and anything else."""
    return F.when(stripped(text) != "", number(text)).try_cast("long")


def milliseconds(seconds: Column) -> Column:
    return F.floor(seconds * 1000 + F.lit(0.5)).cast("long")


def _clock(text: Column) -> Column:
    """Seconds of ``[h:]m:s``; with hours, minutes end at 60, seconds always do."""

    def read(parts: Column) -> Column:
        n = F.size(parts)
        values = F.transform(parts, number)

        def seconds(v: Column) -> Column:
            h, m, s = F.when(n == 3, F.get(v, F.lit(0))).otherwise(0.0), F.get(v, n - 2), F.get(v, n - 1)
            good = F.forall(v, lambda x: F.coalesce(x >= 0, F.lit(False))) & n.between(2, 3) & (s < 60) & ((n == 2) | (m < 60))
            return F.when(good, h * 3600 + m * 60 + s)

        return once(values, seconds)

    return once(F.split(text, ":", -1), read)


def rule_time(text: Column) -> Column:
    """Milliseconds of a time in durations and cut points; a number without colons counts minutes."""

    def read(t: Column) -> Column:
        minutes = F.regexp_extract(t, rf"(?i)^([0-9]+(?:\.[0-9]+)?){MINUTES}?\z", 1)
        return milliseconds(F.when(t.contains(":"), _clock(t)).when(minutes != "", minutes.try_cast("double") * 60))

    return once(F.regexp_replace(text, f"[{BLANKS}]+", ""), read)


def anchor_time(text: Column) -> Column:
    """Milliseconds of a time in anchors, which must have a colon."""
    return once(stripped(text), lambda t: milliseconds(F.when(t.contains(":"), _clock(t))))


def minutes_input(text: Column) -> Column:
    """Milliseconds of a number of minutes; null for blank texts, other texts and negative numbers."""
    value = number(text)
    return F.when((stripped(text) != "") & (value >= 0), milliseconds(value * 60))


def _lines(text: Column, keep: Callable[[Column], Column]) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n", -1), stripped), keep)


def durations(text: Column) -> Column:
    """(line, text, season_number, episode_number, duration_ms) of every line that is not blank; an episode without a
    number has the line's, from 1 on, and a line without a duration has nulls."""

    def entry(line: Column, k: Column) -> Column:
        pattern = rf"(?is)\A(.*?)({DURATION})[{BLANKS}]*\z"
        length = rule_time(F.regexp_extract(line, pattern, 2))
        label = stripped(F.regexp_replace(F.regexp_extract(line, pattern, 1), r"[=:：,-]+\z", ""))

        def named(x: Column) -> Column:
            season = F.coalesce(_group(x, SEASON_EPISODE, 1), _group(x, SEASON_EPISODE_CJK, 1))
            episode = F.coalesce(_group(x, SEASON_EPISODE, 2), _group(x, SEASON_EPISODE_CJK, 2), _group(x, EPISODE_LAST, 1), k + 1)
            good = length > 0
            return F.struct((k + 1).alias("line"), line.alias("text"), F.when(good, season).alias("season_number"), F.when(good, episode).alias("episode_number"), F.when(good, length).alias("duration_ms"))

        return once(label, named)

    return F.transform(_lines(text, lambda x: x != ""), entry)


def _group(text: Column, pattern: str, k: int) -> Column:
    found = F.regexp_extract(text, pattern, k)
    return F.when(found != "", found).cast("int")


def cut_points(text: Column) -> Column:
    """(text, at_ms) of every entry between line breaks, commas and semicolons; null where it is no time."""
    entries = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), CUT_SIGNS, -1), stripped), lambda x: x != "")
    return F.transform(entries, lambda x: F.struct(x.alias("text"), rule_time(x).alias("at_ms")))


def anchors(text: Column) -> Column:
    """(line, text, fault, source_ms, target_ms) of every line that is neither blank nor begins with #; ``fault`` is
    ``parts`` where there are not two times, ``time`` where one of them cannot be read."""

    def entry(line: Column, k: Column) -> Column:
        def sides(p: Column) -> Column:
            two = F.size(p) == 2

            def pair(x: Column) -> Column:
                both = x["a"].isNotNull() & x["b"].isNotNull()
                fault = F.when(~two, F.lit("parts")).when(~both, F.lit("time"))
                return F.struct((k + 1).alias("line"), line.alias("text"), fault.alias("fault"), F.when(both, x["a"]).alias("source_ms"), F.when(both, x["b"]).alias("target_ms"))

            return once(F.struct(F.when(two, anchor_time(F.get(p, F.lit(0)))).alias("a"), F.when(two, anchor_time(F.get(p, F.lit(1)))).alias("b")), pair)

        return once(F.filter(F.split(line, ANCHOR_SIGNS, -1), lambda x: x != ""), sides)

    return F.transform(_lines(text, lambda x: (x != "") & ~F.startswith(x, F.lit("#"))), entry)

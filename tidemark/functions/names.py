"""Column functions for names: hashes, keys, safe texts and episode identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.session import once

#: Full-width letters, digits and signs and the ASCII ones they stand for; the part of NFKC that file names need.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
#: Dashes and words that separate the two ends of a range, and the numerals of episode names (fixed values).
DASHES = "‐‑‒–—﹣－~～至到"
NUMERALS = "零〇一二两三四五六七八九"
VALUES = "001223456789"
NUMBER = "[零〇一二三四五六七八九十百两0-9]{1,6}"
UNIT = "[集话話]"
#: Colours of assets in order (fixed values).
COLORS = ("#4cc9f0", "#7bd88f", "#f2c94c", "#ff8f70", "#b794f4", "#5eead4", "#f472b6")


def _fold(text: Column, signed: bool) -> Column:
    """h = 31 h + code over UTF-16 units of the text, in 32 bits."""
    units = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    total = F.aggregate(F.filter(units, lambda u: u > 0), F.lit(0).cast("long"), lambda h, u: F.pmod(h * 31 + u, F.lit(2**32)))
    return F.when(total >= 2**31, total - 2**32).otherwise(total) if signed else total


def stable_hash(text: Column) -> Column:
    """A 32-bit hash of a text in base 36, for code points of the basic plane."""
    return F.lower(F.conv(_fold(text, False).cast("string"), 10, 36))


def color_of(name: Column) -> Column:
    """The colour that a name always gets."""
    return F.element_at(F.array(*[F.lit(c) for c in COLORS]), (F.abs(_fold(name, True)) % len(COLORS) + 1).cast("int"))


def score_text(value: Column) -> Column:
    """Lower case without ending, seasons and episodes as s1 and e2, everything else than letters and digits a blank."""
    out = F.regexp_replace(F.lower(value), r"\.[a-z0-9]+$", "")
    out = F.regexp_replace(out, r"第\s*([0-9]+)\s*季", "s$1")
    out = F.regexp_replace(out, r"第\s*([0-9]+)\s*[集话]", "e$1")
    return F.trim(F.regexp_replace(out, "[^a-z0-9一-鿿]+", " "))


def landmark_key(anchor: Column, target: Column, delta_ms: Column, quantum: int = 50) -> Column:
    """Two frequency bins and their distance in time as one number."""
    return F.shiftleft(anchor.cast("long"), 16).bitwiseOR(F.shiftleft(target.cast("long"), 8)).bitwiseOR(F.floor(delta_ms / quantum))


def _number(text: Column) -> Column:
    """Arabic or Chinese numeral up to 999; null for anything else."""

    def digit(c: Column, empty: int) -> Column:
        return F.when(c == "", F.lit(empty)).otherwise(F.translate(F.substring(c, -1, 1), NUMERALS, VALUES).try_cast("int"))

    hundreds = F.when(text.contains("百"), digit(F.regexp_extract(text, "^([^百]*)百", 1), 1) * 100).otherwise(0)
    rest = F.regexp_replace(text, "^[^百]*百", "")
    tens = F.when(rest.contains("十"), digit(F.regexp_replace(F.regexp_extract(rest, "^([^十]*)十", 1), "[零〇]", ""), 1) * 10).otherwise(0)
    ones = digit(F.regexp_replace(rest, "^[^十]*十", ""), 0)
    # A text without either kind of numeral has none.
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int")).when(text.rlike("^[零〇一二三四五六七八九十百两]+$"), hundreds + tens + ones)


def _stripped(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def episode_text(text: Column) -> Column:
    """Narrow letters, one kind of dash and single blanks."""
    out = F.translate(F.translate(text, _WIDE, _NARROW), DASHES, "-" * len(DASHES))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _identity(ok: Column, season: Column, first: Column, last: Column, part: Column, pattern, strength: Column, bounded: bool) -> Column:
    """struct(season, first, last, part, pattern, strength), or null where the numbers make no identity.

    ``pattern`` gives the form's name from the numbers; ``last`` is null where the name has no second end.
    """

    def made(n: Column) -> Column:
        end = F.coalesce(n["last"], n["first"])
        low, high = (F.least(n["first"], end), F.greatest(n["first"], end)) if bounded else (n["first"], end)
        good = (low >= 0) & (high >= low)
        if bounded:
            good = good & ((low == high) | ((low > 0) & (high - low + 1 <= 80)))
        out = F.struct(n["season"].alias("season"), low.alias("first"), high.alias("last"), n["part"].alias("part"), pattern(n).alias("pattern"), strength.alias("strength"))
        return F.when(F.coalesce(good, F.lit(False)), out)

    numbers = F.struct(season.cast("int").alias("season"), first.cast("int").alias("first"), last.cast("int").alias("last"), part.cast("int").alias("part"))
    return F.when(ok, once(numbers, made))


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def episode_identity(text: Column, ordered: bool = False) -> Column:
    """struct(season, first, last, part, pattern, strength) of a name; null without any.

    The first form that occurs decides: S01E02 (with a range), a season and an episode in words, E02, an episode in
    words; with ``ordered`` also a bare range, ``3.2`` as a part, and a bare number.
    """
    t = episode_text(text)
    if not ordered:
        t = F.regexp_replace(t, f"(?:全|共)\\s*{NUMBER}\\s*{UNIT}", " ")
    part = _filled(F.regexp_extract(t, r"(?i)(?:PART|PT|P)\s*([0-9]{1,3})(?:\b|$)", 1)).try_cast("int")
    both = F.struct(t.alias("t"), part.alias("part"), F.regexp_replace(t, r"\s+", "").alias("compact"))
    return once(both, lambda b: _first_form(b["t"], b["part"], b["compact"], ordered))


def _first_form(t: Column, part: Column, compact: Column, ordered: bool) -> Column:
    none = F.lit(None)

    def form(pattern: str, groups: tuple, name: str, strength: Column, number) -> tuple[Column, Column]:
        season, first, last = (number(_filled(F.regexp_extract(t, pattern, g))) if g else none for g in groups)

        def kind(n: Column) -> Column:
            return F.when(n["last"].isNotNull(), F.lit(f"{name}Range")).when(n["part"].isNull(), F.lit(name)).otherwise("episodePart")

        found = t.rlike(pattern)
        return found, _identity(found, season, first, last, part, kind, strength, ordered)

    def bare(pattern: str, last: int, part_at: int, name: str, strength: str, bounded: bool) -> tuple[Column, Column]:
        first, end, own = (_filled(F.regexp_extract(compact, pattern, g)).try_cast("int") if g else none for g in (1, last, part_at))
        found = compact.rlike(pattern)
        return found, _identity(found, none, first, end, own, lambda n: F.lit(name), F.lit(strength), bounded)

    def arabic(x: Column) -> Column:
        return x.try_cast("int")

    strong, by_part = F.lit("strong"), F.when(part.isNull(), "moderate").otherwise("strong")
    forms = [
        form(r"(?i)\bS([0-9]{1,3})\s*E([0-9]{1,4})(?:\s*-\s*(?:S[0-9]{1,3}\s*)?E?([0-9]{1,4}))?\b", (1, 2, 3), "seasonEpisode", strong, arabic),
        form(f"(?i)第?({NUMBER})\\s*季\\s*第?\\s*({NUMBER})(?:\\s*-\\s*第?\\s*({NUMBER}))?\\s*{UNIT}?", (1, 2, 3), "seasonEpisode", strong, _number),
        form(r"(?i)\bE(?:P)?\s*([0-9]{1,4})(?:\s*-\s*E?([0-9]{1,4}))?\b", (0, 1, 2), "episode", by_part, arabic),
        form(f"(?i)第?\\s*({NUMBER})(?:\\s*-\\s*第?\\s*({NUMBER}))?\\s*{UNIT}", (0, 1, 2), "episode", by_part, _number),
    ]
    if ordered:
        forms += [
            bare(f"^第?([0-9]{{1,3}})-([0-9]{{1,3}}){UNIT}?$", 2, 0, "episodeRange", "moderate", True),
            bare(DOTTED, 0, 2, "episodePart", "strong", False),
            bare(f"^第?([0-9]{{1,4}}){UNIT}?$", 0, 0, "episode", "moderate", True),
        ]
    out = F.lit(None).cast(IDENTITY)
    for found, identity in reversed(forms):
        out = F.when(found, identity).otherwise(out)
    return out


IDENTITY = "struct<season:int,first:int,last:int,part:int,pattern:string,strength:string>"
#: ``3.2`` as an episode and its part.
DOTTED = r"^第?([0-9]{1,3})[._]([0-9]{1,3})(?:[^0-9]|$)"


def ordered_identity(file_name: Column, order: Column) -> Column:
    """struct(identity..., sort, fallback) of a file; without any identity its place in the list counts."""
    stem = _stripped(F.translate(file_name, _WIDE, _NARROW))
    direct = F.regexp_replace(episode_text(stem), r"\s+", "")
    prefix = r"^\s*([0-9]{1,4})\s*[-_.)、]\s*(.+)$"
    has = stem.rlike(prefix)
    sort = F.when(has, F.regexp_extract(stem, prefix, 1).try_cast("long")).otherwise(order + 1)
    parsed = episode_identity(F.when(has, F.regexp_extract(stem, prefix, 2)).otherwise(stem), ordered=True)
    first, part = (F.regexp_extract(direct, DOTTED, g).try_cast("int") for g in (1, 2))
    two = _identity(direct.rlike(DOTTED), F.lit(None), first, F.lit(None), part, lambda n: F.lit("episodePart"), F.lit("strong"), False)

    def made(x: Column, at: Column, fallback: bool) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("season", "first", "last", "part", "pattern", "strength")], at.cast("long").alias("sort"), F.lit(fallback).alias("fallback"))

    none = F.lit(None).cast("int")
    place = (order + 1).cast("int")
    alone = F.struct(none.alias("season"), place.alias("first"), place.alias("last"), none.alias("part"), F.lit("importOrderFallback").alias("pattern"), F.lit("fallback").alias("strength"))
    either = F.struct(two.alias("two"), parsed.alias("parsed"), sort.alias("sort"))
    return once(either, lambda e: F.when(e["two"].isNotNull(), made(e["two"], order + 1, False)).when(e["parsed"].isNotNull(), made(e["parsed"], e["sort"], False)).otherwise(made(alone, e["sort"], True)))

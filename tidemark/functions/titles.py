"""Keys of titles and links, by which the same work or resource is known again."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.rules import BLANKS, stripped
from tidemark.session import once

#: Characters that file names cannot have (fixed values).
UNNAMED = r'[\\/:*?"<>|\p{Cntrl}]'


def nfkc(text: Column) -> Column:
    """Compatibility composition, which Spark has no function for; in Arrow batches."""

    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(composed, "string")(text)


def normalized_title(title: Column) -> Column:
    """A composed title without its ending, in lower case, with single blanks and without characters names cannot have."""
    bare = F.regexp_replace(nfkc(title), r"(?s)\.[^.]+\z", "")
    named = F.regexp_replace(F.lower(bare), f"(?U){UNNAMED}", " ")
    return stripped(F.regexp_replace(named, f"[{BLANKS}]+", " "))


def resource_key(title: Column, year: Column, kind: Column, season: Column, episode: Column) -> Column:
    """``title|year|kind[|sN]|episode`` of a resource; null where a part is missing or out of range."""
    known = (F.length(stripped(title)) > 0) & (F.length(title) <= 120) & year.between(1900, 2100) & kind.isin("tv", "movie") & (season >= 1) & ((kind != "tv") | episode.isNotNull()) & (episode.isNull() | (episode >= 1))
    name = normalized_title(title)
    parts = [name, year.cast("string"), kind, F.when(season != 1, F.concat(F.lit("s"), season.cast("string"))), F.coalesce(episode.cast("string"), F.lit("all"))]
    return F.when(known & (F.length(name) > 0), F.concat_ws("|", *parts))


def library_title(title: Column) -> Column:
    """A composed title in lower case without punctuation and blanks."""
    return F.regexp_replace(F.lower(nfkc(title)), rf"[\p{{P}}\p{{Z}}{BLANKS}_]+", "")


def work_key(title: Column, kind: Column, year: Column) -> Column:
    """The key of a work of the library: 48 digits of a digest of its kind, title and year."""
    text = F.concat(kind, F.lit(":"), library_title(title), F.lit(":"), F.coalesce(year.cast("string"), F.lit("")))
    return F.concat(F.lit("title-"), F.substring(F.sha2(text, 256), 1, 48))


def library_episode(name: Column) -> Column:
    """(season, episode) of a file's name, each null where it is not told."""

    def part(pattern: str, k: int) -> Column:
        found = F.regexp_extract(name, pattern, k)
        return F.when(found != "", found.try_cast("long"))

    both = r"(?i)(?:^|[^a-z0-9])S([0-9]{1,3})[ ._-]*E([0-9]{1,4})(?![0-9])"
    season = F.coalesce(part(rf"(?i)第[{BLANKS}]*([0-9]+)[{BLANKS}]*季", 1), part(r"(?i)(?:^|[^a-z0-9])S([0-9]{1,3})(?![a-z0-9])", 1))
    alone = F.struct(season.alias("season"), part(rf"第[{BLANKS}]*([0-9]+)[{BLANKS}]*[集话]", 1).alias("episode"))
    return F.when(part(both, 1).isNotNull(), F.struct(part(both, 1).alias("season"), part(both, 2).alias("episode"))).otherwise(alone)


def magnet(text: Column, longest: int = 16_384) -> Column:
    """A magnet link with a known kind of hash, a bare hash as such a link; null for anything else."""

    def read(t: Column) -> Column:
        bare = t.rlike(r"\A(?:[A-Fa-f0-9]{40}|[A-Za-z2-7]{32})\z")
        link = F.when(bare, F.concat(F.lit("magnet:?xt=urn:btih:"), t)).otherwise(F.regexp_replace(t, r"\A(?i)magnet:", "magnet:"))
        hashed = link.rlike(r"\Amagnet:\?(?:[^#]*&)?xt=(?i:urn(?::|%3a)bt(?:ih(?::|%3a)(?:[a-f0-9]{40}|[a-z2-7]{32})|mh(?::|%3a)1220[a-f0-9]{64}))(?:&|#|\z)")
        return F.when((F.length(t) <= longest) & hashed, link)

    return once(stripped(text), read)

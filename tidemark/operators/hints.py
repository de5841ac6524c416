"""Comments that hint at removed scenes: rules, matches, and the clusters of a whole set of files."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.merging import cluster_details


@dataclass(frozen=True)
class HintRule:
    label: str
    pattern: str
    weight: int


#: The rules that hold where none are given (fixed values).
DEFAULT_RULES = (
    HintRule("删了", "删了|删掉|删减|被删|删过|删了一段|删没了|删掉了", 3),
    HintRule("剪了", "剪了|剪掉|剪辑|剪过|剪没了|被剪|剪掉了", 3),
    HintRule("跳了", "跳了|跳过|怎么跳|突然跳|跳剧情|跳了一段", 2),
    HintRule("和谐", "和谐|河蟹|阉割|被砍|砍了", 3),
    HintRule("没了", "没了|少了|缺了|不见了|中间没|少一段", 2),
)
#: What stands between keywords, the weight of one, and the clusters shown (fixed values).
BETWEEN, KEYWORD_WEIGHT, SHOWN = r"[\s,，、;；|]+", 2, 12


def keyword_rules(text: str, weight: int = KEYWORD_WEIGHT) -> tuple[HintRule, ...]:
    """A rule for every different keyword of a text, read as it stands and in any case."""
    words = dict.fromkeys(w for w in re.split(BETWEEN, text) if w)
    return tuple(HintRule(w, "(?iu)" + re.sub(r"([\\.*+?^${}()|\[\]])", r"\\\1", w), weight) for w in words)


def search_plan(window_seconds: str, least_hits: str) -> tuple[int | None, int | None, tuple[str, ...]]:
    """(window in ms, least hits, warnings) of a search's settings; what cannot be read is None and warned of."""

    def number(text: str) -> float | None:
        try:
            value = float(text.strip())
        except ValueError:
            return None
        return value if abs(value) != float("inf") and value == value and "_" not in text else None

    seconds, hits = number(window_seconds), number(least_hits)
    window = int(seconds * 1000 + 0.5) if seconds and seconds > 0 else None
    least = int(hits) if hits and hits > 0 and hits == int(hits) else None
    return window, least, tuple(name for name, value in (("window", window), ("hits", least)) if value is None)


def keywords(text: Column, rules: tuple[HintRule, ...]) -> Column:
    """Labels of the rules that a text meets, in the rules' order."""
    return F.array_compact(F.array(*[F.when(text.rlike(r.pattern), F.lit(r.label)) for r in rules])) if rules else F.array().cast("array<string>")


def weight_of(labels: Column, rules: tuple[HintRule, ...]) -> Column:
    total = F.lit(0)
    for r in rules:
        total = total + F.when(F.array_contains(labels, r.label), r.weight).otherwise(0)
    return total


def suspected_cuts(items: DataFrame, rules: tuple[HintRule, ...] = DEFAULT_RULES, window_ms: int = 60_000, least: int = 2, samples: int = 3, shown: int = SHOWN) -> DataFrame:
    """The clusters with the highest scores of all files together, of equal ones the earlier.

    ``items`` is (asset_id, original_index, at_ms, text).  Spark keeps the ``shown`` best of every partition, so no
    task sorts all clusters.
    """
    hits = items.withColumn("_k", keywords(F.col("text"), rules)).filter(F.size("_k") > 0).withColumn("_w", weight_of(F.col("_k"), rules))
    found = cluster_details(hits, ["asset_id"], "at_ms", "original_index", "text", "_w", "_k", window_ms, least, samples)
    return found.orderBy(F.desc("score"), "middle_ms", "asset_id", "bucket").limit(shown)

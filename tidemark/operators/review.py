"""Votes, families, splits, metrics and library bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.components import connected_components
from tidemark.operators.measures import classification
from tidemark.session import cut


def adjudicate(votes: DataFrame, subject: str, reviewer: str, at: str, vote: str, role: str) -> DataFrame:
    """(subject, votes, state, decision, resolution) of active votes.

    Each independent reviewer's latest vote counts.  Two or more who agree, none of them undecided (a null vote), make
    a subject ``gold``.  Where two or more decisions stand against each other, the latest decided vote of an
    adjudicator who is not one of the reviewers settles it; without one it is a ``conflict``.  All others wait.
    """
    latest = votes.filter(F.col(role) == "independent").groupBy(subject, reviewer).agg(F.max_by(F.struct(F.col(vote).alias("v")), at)["v"].alias("v"))
    per = latest.groupBy(subject).agg(F.count(F.lit(1)).alias("votes"), F.count("v").alias("decided"), F.min("v").alias("low"), F.max("v").alias("high"))
    outside = votes.filter((F.col(role) == "adjudicator") & F.col(vote).isNotNull()).join(latest.select(subject, reviewer), [subject, reviewer], "left_anti")
    settled = outside.groupBy(subject).agg(F.max_by(vote, at).alias("ruling"))
    all_ = votes.select(subject).distinct().join(per, subject, "left").join(settled, subject, "left").withColumn("votes", F.coalesce("votes", F.lit(0).cast("long")))
    agreed = (F.col("votes") >= 2) & (F.col("decided") == F.col("votes")) & (F.col("low") == F.col("high"))
    against = (F.col("votes") >= 2) & (F.col("low") != F.col("high"))
    resolution = F.when(agreed, "independentAgreement").when(against & F.col("ruling").isNotNull(), "adjudicator")
    decision = F.when(agreed, F.col("low")).when(resolution == "adjudicator", F.col("ruling"))
    return all_.select(subject, "votes", F.when(resolution.isNotNull(), "gold").when(against, "conflict").otherwise("awaiting-independent").alias("state"), decision.alias("decision"), resolution.alias("resolution"))


def families(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, family): the smallest id reachable over ``edges`` (a, b).

    Labels are taken from neighbours and then from the label's own label, so paths halve every round.
    """
    both = cut(edges.union(edges.select("b", "a")).toDF("u", "v").distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("f")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("f").alias("g"))
        step = labels.join(near, "u").select("u", F.least("f", "g").alias("f"))
        jump = step.join(step.select(F.col("u").alias("f"), F.col("f").alias("h")), "f", "left").select("u", F.least("f", "h").alias("f"))
        after = cut(jump)
        changed = after.join(labels.withColumnRenamed("f", "old"), "u").filter("f <> old").limit(1).count()
        labels = after
        if not changed:
            break
    else:
        raise RuntimeError(f"families did not settle in {rounds} rounds")
    return labels.select(F.col("u").alias("id"), F.col("f").alias("family"))


def whole_families(edges: DataFrame) -> DataFrame:
    """``families`` by stars, for ids that are numbers: no key gathers more than its own links, however large a family."""
    links = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    found = connected_components(links)
    alone = links.filter("a = b").select(F.col("a").alias("id")).distinct().join(found, "id", "left_anti")
    return found.select("id", F.col("component").alias("family")).union(alone.select("id", F.col("id").alias("family")))


def hash_split(rows: DataFrame, key: str, train: int = 80, tune: int = 10) -> DataFrame:
    """A stable split by the first 32 bits of the key's digest."""
    bucket = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long") % 100
    return rows.withColumn("bucket", bucket).withColumn("part", F.when(bucket < train, "train").when(bucket < train + tune, "tune").otherwise("test"))


def lift(rows: DataFrame, a: str, b: str) -> DataFrame:
    """How much more often a pair of values occurs than independence would have it; one pass over the rows."""
    cells = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    of_a, of_b = (cells.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in (a, b))
    total = cells.agg(F.sum("n").alias("total"))
    return cells.join(of_a, a).join(of_b, b).crossJoin(F.broadcast(total)).withColumn("lift", F.col("n") * F.col("total") / (F.col(f"n_{a}") * F.col(f"n_{b}")))


def prf(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Counts, precision, recall and F1 of a predicate; measures.classification says what 0 / 0 is."""
    counts = rows.agg(*[F.count_if(p & a).alias(n) for n, p, a in (("tp", predicted, actual), ("fp", predicted, ~actual), ("fn", ~predicted, actual), ("tn", ~predicted, ~actual))])
    return classification(counts)


def diff(held: DataFrame, wanted: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """What turns ``held`` into ``wanted``: insert, update, delete or keep."""
    action = F.when(F.col(b).isNull(), "delete").when(F.col(a).isNull(), "insert").when(F.col(a) != F.col(b), "update").otherwise("keep")
    return held.join(wanted, key, "full").select(key, action.alias("action"))


#: What adds to a record's urgency: conflicts of reviewers, changes of mind, drifted borders, open decisions, rough and
#: played-back looks, each revision and the most these add, and the weights of risk, ambiguity, ambiguous pictures, a
#: small lead and a model's risk (fixed values).
CONFLICT, CHANGED, DRIFTED, OPEN, ROUGH, PLAYED, REVISION, MOST_REVISIONS = 100, 55, 35, 28, 22, 10, 4, 12
RISK, AMBIGUITY, PICTURES, LEAD, MODEL = 30, 20, 12, 12, 30
#: Scores from which a record is critical and high, and the least drift of a border in ms (fixed values).
CRITICAL, HIGH, LEAST_DRIFT_MS = 90, 50, 1_000


def active_review(records: DataFrame, states: DataFrame, subject: list[str], order: list[str]) -> DataFrame:
    """(record_id, score, level, revisions, changed, drift_ms) of every subject's last record, by how urgent a look is.

    ``records`` is all records of the subjects with record_id, decision, precision, tolerance_ms, the four borders and
    the shares difference_risk, ambiguous, visual_ambiguous, margin and model_risk, of which the last's count; ``states``
    is (record_id, state) of the votes.  Gold records score 0.  A border has drifted if one revision lies further from
    the last than the largest tolerance and a second.
    """
    borders = ["source_start", "source_end", "target_start", "target_end"]
    last = records.groupBy(*subject).agg(F.max_by(F.struct(*[c for c in records.columns if c not in subject]), F.struct(*order)).alias("r"))
    both = records.select(*subject, F.col("record_id").alias("_id"), F.col("decision").alias("_d"), F.col("tolerance_ms").alias("_t"), *[F.col(c).alias(f"_{c}") for c in borders]).join(last, subject)
    prior = F.col("_id") != F.col("r.record_id")
    away = F.greatest(*[F.abs(F.col(f"_{c}") - F.col(f"r.{c}")) for c in borders])
    facts = both.groupBy(*subject).agg(F.count_if(prior).alias("revisions"), F.coalesce(F.bool_or(prior & ~F.col("_d").eqNullSafe(F.col("r.decision"))), F.lit(False)).alias("changed"), F.coalesce(F.max(F.when(prior, away)), F.lit(0)).alias("drift_ms"), F.max(F.coalesce("_t", F.lit(0))).alias("_tolerance"))
    rows = last.join(facts, subject).select(*subject, "r.*", "revisions", "changed", "drift_ms", "_tolerance").join(states.select("record_id", "state"), "record_id", "left")
    add = lambda when, points: F.when(when, F.lit(float(points))).otherwise(0.0)

    def share(c: str, weight: int, turned: bool = False) -> Column:
        x = F.col(c).cast("double")
        held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
        return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), ((1 - held) if turned else held) * weight).otherwise(0.0)

    score = (
        add(F.col("state") == "conflict", CONFLICT) + add(F.col("changed"), CHANGED) + add(F.col("drift_ms") > F.greatest(F.lit(LEAST_DRIFT_MS), F.col("_tolerance")), DRIFTED) + add(F.col("decision") == "unresolved", OPEN)
        + add(F.col("precision") == "rough", ROUGH) + add(F.col("precision") == "playbackChecked", PLAYED) + F.least(F.lit(MOST_REVISIONS), F.col("revisions") * REVISION)
        + share("difference_risk", RISK) + share("ambiguous", AMBIGUITY) + share("visual_ambiguous", PICTURES) + share("margin", LEAD, True) + share("model_risk", MODEL)
    )
    gold = F.coalesce(F.col("state") == "gold", F.lit(False))
    rows = rows.withColumn("score", F.when(gold, 0.0).otherwise(F.floor(score * 10 + F.lit(0.5)) / 10))
    level = F.when(gold, "gold").when(F.col("score") >= CRITICAL, "critical").when(F.col("score") >= HIGH, "high").otherwise("normal")
    return rows.select("record_id", "score", level.alias("level"), "revisions", "changed", "drift_ms")

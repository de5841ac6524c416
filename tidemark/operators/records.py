"""Records that are never changed: corrections supersede, votes are admitted by rules, and revisions need the right head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import canonical as C
from tidemark.operators.folds import fold

#: Shortest and longest name of a reviewer, and what is hashed before it (fixed values).
LEAST_NAME, MOST_NAME, NAME_SCOPE = 3, 80, "alignment-reviewer-v1:"
INDEPENDENT, ADJUDICATOR, UNRESOLVED = "independent", "adjudicator", "unresolved"


def superseding(log: DataFrame, subject: list[str], order: list[str], key: str) -> DataFrame:
    """``log`` with ``supersedes``, the record of the same subject before, and ``state``, active for the last one."""
    w = W.partitionBy(*subject).orderBy(*order)
    state = F.when(F.lead(key).over(w).isNull(), "active").otherwise("superseded")
    return log.withColumns({"supersedes": F.lag(key).over(w), "state": state})


def current(log: DataFrame, subject: list[str], order: list[str]) -> DataFrame:
    """The last record of every subject, found without moving the others."""
    last = log.groupBy(*subject).agg(F.max_by(F.struct(*log.columns), F.struct(*order)).alias("_last"))
    return last.select("_last.*")


def review_id(time_map: Column, revision: Column, span: Column, decision: Column, precision: Column, reviewed_at: Column, s0: Column, s1: Column, t0: Column, t1: Column) -> Column:
    """The id of a review record, which follows from what was reviewed and how."""
    labels = ("sourceStartMs", "sourceEndMs", "targetStartMs", "targetEndMs")
    area = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), x.cast("string")) for n, x in zip(labels, (s0, s1, t0, t1), strict=True))), F.lit("}"))
    texts = [C.quoted(x) for x in (time_map,)] + [revision.cast("string")] + [C.quoted(x) for x in (span, decision, precision, reviewed_at)]
    return C.digest(C.json_array([*texts, area]), "alignment-review:")


def reviewer_digest(name: Column) -> Column:
    return C.digest(F.concat(F.lit(NAME_SCOPE), F.trim(name)))


def admitted_votes(records: DataFrame, votes: DataFrame, order: list[str]) -> DataFrame:
    """Every vote with whether it counts and why not, what it supersedes and whether it is still active.

    ``records`` is (record_id, state); ``votes`` is (record_id, vote_id, reviewer, session, role, decision,
    tolerance_ms, and the columns of ``order``).  A vote needs an active record, a reviewer's name of fair length, a
    session and no negative tolerance.  An adjudicator is admitted only once two independent reviewers have come to
    different conclusions, and must be neither of them.  Another vote of the same reviewer in the same role
    supersedes the one before.  Votes of a record are taken in order; the state is each reviewer's last decision.
    """
    name = F.length(F.trim("reviewer"))
    fault = (
        F.when(F.col("_state").isNull() | (F.col("_state") != "active"), "record")
        .when(F.col("reviewer").isNull() | ~name.between(LEAST_NAME, MOST_NAME), "reviewer")
        .when(F.coalesce(F.trim("session"), F.lit("")) == "", "session")
        .when(F.col("tolerance_ms") < 0, "tolerance")
    )
    known = records.select("record_id", F.col("state").alias("_state"))
    rows = votes.join(known, "record_id", "left").withColumns({"_fault": fault, "_who": reviewer_digest(F.col("reviewer"))})

    def step(state: dict | None, row: dict) -> tuple[dict, list[tuple]]:
        state = state or {}
        fault, who, role = row["_fault"], row["_who"], row["role"]
        if fault is None and role == ADJUDICATOR:
            independent = {w: d for (w, r), (_, d) in state.items() if r == INDEPENDENT}
            if len(independent) < 2 or len({d for d in independent.values() if d != UNRESOLVED}) < 2:
                fault = "noConflict"
            elif who in independent:
                fault = "sameReviewer"
        before = state.get((who, role), (None, None))[0] if fault is None else None
        if fault is None:
            state = {**state, (who, role): (row["vote_id"], row["decision"])}
        return state, [(row["vote_id"], who, role, row["decision"], row["tolerance_ms"], fault, before)]

    kind = votes.schema["vote_id"].dataType.simpleString()
    narrow = rows.select("record_id", "vote_id", "role", "decision", F.col("tolerance_ms").cast("long"), "_fault", "_who", *[c for c in order if c not in ("record_id", "vote_id")])
    out = fold(narrow, ["record_id"], order, step, f"vote_id {kind}, reviewer_digest string, role string, decision string, tolerance_ms bigint, fault string, supersedes {kind}")
    later = out.filter("supersedes IS NOT NULL").select("record_id", F.col("supersedes").alias("vote_id"), F.lit(True).alias("_later")).distinct()
    state = F.when(F.col("fault").isNotNull(), F.lit(None)).when(F.col("_later"), "superseded").otherwise("active")
    return out.join(later, ["record_id", "vote_id"], "left").withColumn("state", state).drop("_later")


KINDS = ("autosave", "checkpoint", "rollback")
COMMIT_SCHEMA = "mutation_id string, status string, revision bigint, head bigint"


def commits(heads: DataFrame, mutations: DataFrame, order: list[str]) -> DataFrame:
    """(project, mutation_id, status, revision, head): what becomes of every mutation, taken in order.

    ``heads`` is (project, head); ``mutations`` is (project, mutation_id, request_hash, expected_head, kind,
    source_revision, and the columns of ``order``).  ``committed`` gives the next revision; ``replayed`` a mutation
    that was committed before with the same request, with its revision; ``mismatch`` one with another request;
    ``conflict`` an expected head that is not the project's; ``unknown`` a project without head; ``invalid`` a
    rollback without a source revision, a source revision with anything else, or another kind.
    """
    known = heads.select("project", F.col("head").alias("_head"))
    wrong = ~F.col("kind").isin(*KINDS) | ((F.col("kind") == "rollback") != F.col("source_revision").isNotNull()) | F.coalesce(F.col("source_revision") < 1, F.lit(False))
    rows = mutations.join(known, "project", "left").withColumn("_wrong", F.coalesce(wrong, F.lit(True)))

    def step(state: tuple | None, row: dict) -> tuple[tuple, list[tuple]]:
        head, receipts = state or (row["_head"], {})
        key = row["mutation_id"]
        if row["_wrong"]:
            return (head, receipts), [(key, "invalid", None, head)]
        if key in receipts:
            same = receipts[key][0] == row["request_hash"]
            return (head, receipts), [(key, "replayed" if same else "mismatch", receipts[key][1] if same else None, head)]
        if head is None:
            return (head, receipts), [(key, "unknown", None, None)]
        if row["expected_head"] != head:
            return (head, receipts), [(key, "conflict", None, head)]
        receipts[key] = (row["request_hash"], head + 1)
        return (head + 1, receipts), [(key, "committed", head + 1, head + 1)]

    columns = ["project", "mutation_id", "request_hash", "expected_head", "source_revision", "_head", "_wrong"]
    return fold(rows.select(*columns, *[c for c in order if c not in columns]), ["project"], order, step, COMMIT_SCHEMA)


def commit_snapshots(path: str, mutations: DataFrame, order: list[str]) -> DataFrame:
    """Appends the mutations that are committed to the revisions at ``path`` (project, revision, mutation_id,
    request_hash, kind, source_revision, snapshot, and the columns of ``order``) and gives what became of all.

    Mutations that the revisions hold already are replays, so a job that ran twice writes nothing twice.  One writer
    at a time is assumed for a project.
    """
    from tidemark.session import cut

    spark = mutations.sparkSession
    held = spark.read.parquet(path)
    done = held.select("project", "mutation_id", F.col("request_hash").alias("_hash"), F.col("revision").alias("_revision"))
    known = mutations.join(done, ["project", "mutation_id"], "left")
    again = known.filter("_revision IS NOT NULL")
    same = F.col("_hash").eqNullSafe(F.col("request_hash"))
    heads = held.groupBy("project").agg(F.max("revision").alias("head"))
    told = again.join(heads, "project").select("project", "mutation_id", F.when(same, "replayed").otherwise("mismatch").alias("status"), F.when(same, F.col("_revision")).alias("revision"), "head")
    new = known.filter("_revision IS NULL").drop("_hash", "_revision")
    out = cut(told.unionByName(commits(heads, new, order)))
    taken = out.filter("status = 'committed'").select("project", "mutation_id", "revision")
    first = new.withColumn("_n", F.row_number().over(W.partitionBy("project", "mutation_id", "expected_head").orderBy(*order)))
    written = first.join(taken, ["project", "mutation_id"]).filter((F.col("expected_head") == F.col("revision") - 1) & (F.col("_n") == 1))
    cut(written.select(*held.columns)).write.mode("append").parquet(path)
    return out

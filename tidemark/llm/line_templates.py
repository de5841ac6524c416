"""Recurring line templates, found with a fixed-depth tree, in DataFrame functions only.

A line's tokens lead it down a tree: first by their number, then by the first tokens, with tokens that hold digits
taken as variable.  In a leaf, a token stays constant at its place if enough documents have it there; other places
are variable.  Lines with the same constants and enough constant places share a template, and a template that
recurs in enough documents is boilerplate: its first line, by doc_id and place, stays, all others are dropped.

Lines move as digests of their masked wording.  Wordings are read again only in leaves that enough documents share,
and each moves once per task, so neither a common line nor a common leaf gathers in one task.

Cases: a null text stays null and an empty one empty; blank lines are never templates; lines of rows that repeat a
doc_id count for one document; a document whose every line is dropped is removed by ``drop_recurring_lines`` and has
no lines in the report; ties go to the smallest doc_id and place; rows without a doc_id keep all lines; the working
columns are made on the side under names that the documents do not have, so columns of any name pass through; lines
of any length are taken apart in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut, fresh, once, table

#: Leading tokens in the tree, documents that make a template recurring, the share of places that must be constant.
LEADING, MINIMUM_DOCS, CONSTANT_SHARE = 3, 10, 0.7
VARIABLE = "<*>"


def _digest(*parts: Column) -> tuple[Column, Column]:
    """128 bits of what the parts hold."""
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def masked(line: Column) -> Column:
    """A line with single blanks and with tokens that hold digits as variable; linear in its length.

    Most lines have neither digits nor other white space than single blanks, and are only looked through.
    """
    uneven = line.contains("  ")
    for blank in "\t\r\f\x0b":
        uneven = uneven | line.contains(blank)
    plain = F.trim(F.when(uneven, F.regexp_replace(line, r"\s+", " ")).otherwise(line))
    return F.when(line.rlike("[0-9]"), F.regexp_replace(plain, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", VARIABLE)).otherwise(plain)


def leaf_of(wording: Column) -> Column:
    """The place in the tree: the number of tokens and the first ones."""
    blanks = F.octet_length(wording) - F.octet_length(F.replace(wording, F.lit(" "), F.lit("")))
    return F.xxhash64(blanks, F.substring_index(wording, " ", LEADING))


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, line): the lines of every document that are not blank."""
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    return rows.filter(F.col("line").rlike(r"\S"))


def recurring(docs: DataFrame, text: str = "text", minimum: int = MINIMUM_DOCS, share: float = CONSTANT_SHARE) -> tuple[DataFrame, DataFrame]:
    """((doc_id, pos) of lines to drop, templates (template, n_docs, n_lines)) of ``docs``."""
    x, y = _digest(F.col("wording"))
    read = lines(docs, text).select("doc_id", "pos", masked(F.col("line")).alias("wording"))
    placed = cut(read.select("doc_id", "pos", leaf_of(F.col("wording")).alias("leaf"), x.alias("x"), y.alias("y")))
    of_doc = placed.groupBy("leaf", "x", "y", "doc_id").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
    wordings = cut(of_doc.groupBy("leaf", "x", "y").agg(F.count(F.lit(1)).alias("docs")))
    # Leaves that too few documents share hold no template; only the others' wordings are read.
    crowded = cut(wordings.groupBy("leaf").agg(F.sum("docs").alias("n")).filter(F.col("n") >= minimum).select("leaf"))
    inside = read.select("wording", leaf_of(F.col("wording")).alias("leaf")).join(crowded, "leaf", "left_semi").select(x.alias("x"), y.alias("y"), "wording")
    types = wordings.join(crowded, "leaf", "left_semi")
    worded = cut(inside.dropDuplicates(["x", "y"]).join(types, ["x", "y"]).select("x", "y", "leaf", "docs", F.split("wording", " ").alias("tokens")))
    places = worded.filter(F.size("tokens") > LEADING).select("x", "y", "leaf", "docs", F.posexplode("tokens").alias("at", "token"))
    constant = places.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("n")).filter(F.col("n") >= minimum)
    kept = places.join(constant.select("leaf", "at", "token", F.lit(True).alias("constant")), ["leaf", "at", "token"], "left")
    shown = F.struct("at", F.when(F.col("constant"), F.col("token")).otherwise(VARIABLE).alias("token"))
    general = kept.groupBy("x", "y").agg(
        F.transform(F.array_sort(F.collect_list(shown)), lambda p: p["token"]).alias("general"), F.avg(F.coalesce(F.col("constant"), F.lit(False)).cast("int")).alias("share")
    )
    # A line that is too variable for a template still recurs if its own wording does.
    template = F.when((F.col("share") >= share) & (F.col("docs") < minimum), F.col("general")).otherwise(F.col("tokens"))
    named = worded.join(general, ["x", "y"], "left").select("x", "y", template.alias("words"))
    # The wordings that recur by themselves and the general ones must meet under one template.
    p, q = _digest(F.col("words"))
    named = cut(named.select("x", "y", F.array_join("words", " ").alias("template"), p.alias("p"), q.alias("q")))
    first = of_doc.join(named.select("x", "y", "p", "q"), ["x", "y"]).groupBy("p", "q", "doc_id").agg(F.min("pos").alias("pos"), F.sum("n").alias("n"))
    summed = first.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_lines"), F.min_by("pos", "doc_id").alias("keep_pos"), F.min("doc_id").alias("keep_doc"))
    found = cut(named.join(summed.filter(F.col("n_docs") >= minimum), ["p", "q"]))
    drop = placed.join(found.select("x", "y", "keep_doc", "keep_pos"), ["x", "y"]).filter((F.col("doc_id") != F.col("keep_doc")) | (F.col("pos") != F.col("keep_pos")))
    templates = found.groupBy("p", "q", "n_docs", "n_lines").agg(F.min("template").alias("template"))
    return drop.select("doc_id", "pos"), templates.select("template", "n_docs", "n_lines")


def _without(docs: DataFrame, drop: DataFrame, text: str, left: str, dropped: str) -> DataFrame:
    """``docs`` with ``dropped``, the number of dropped lines, and ``left``, the text of the others."""
    key, places = fresh(docs, "id", "places")
    per_doc = drop.groupBy("doc_id").agg(F.collect_set("pos").alias(places)).withColumnRenamed("doc_id", key)
    joined = docs.join(per_doc, docs["doc_id"] == F.col(key), "left").drop(key)
    pieces = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col(places))
    rest = once(F.struct(pieces.alias("p"), stay.alias("k")), lambda s: F.array_join(F.transform(s["k"], lambda k: F.get(s["p"], k)), "\n"))
    return joined.withColumns({left: F.when(F.col(places).isNull(), F.col(text)).otherwise(rest), dropped: F.coalesce(F.size(places), F.lit(0))}).drop(places)


def drop_recurring_lines(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """``docs`` without recurring lines and without the documents of which nothing is left; ``n_chars`` is kept true."""
    drop, _ = recurring(docs, text, **settings)
    left, dropped = fresh(docs, "left", "dropped")
    out = _without(docs, drop, text, left, dropped).filter((F.col(dropped) == 0) | F.col(left).rlike(r"\S")).withColumn(text, F.col(left))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines that are not blank, lines dropped, and the digest of the text that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drop, _ = recurring(docs)
    written = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"\S")))
    return _without(docs, drop, "text", "left", "dropped").select(
        "doc_id", written.cast("long").alias("n_lines"), F.col("dropped").cast("long").alias("n_dropped"), F.sha2(F.coalesce("left", F.lit("")), 256).alias("kept_sha256")
    )

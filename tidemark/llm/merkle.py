"""A Merkle manifest of a table: subroots per source, one root, and a proof for every row.

Rows become leaves; each source's leaves, ascending by id, are hashed in runs of 16 until one digest is left, and
the sources' digests likewise.  For every parent its preimage is stored, the concatenated digests of its children.
A proof is read from the preimages of a leaf's ancestors: the other children are what stays when the leaf's own 64
characters are cut out, and folding puts another digest in their place and hashes the preimage again.

Positions come from a range partitioning by (source, id), so a source may hold any share of all rows.  Preimages of
upper levels are joined from the root downwards, to one row per run; leaves meet them inside the row of their run.

Cases: a null field is `-`; a null source is a source of its own, first in order; rows without an id come first in
their source; rows that repeat an id are ordered by their digests, and every one has its row in the result; a source
with one row has that row's digest as its subroot; an empty table has no rows and no root; further columns of the
documents, whatever their names, are not read.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import cut, table

#: Children of a node, as a power of two, and the characters of a digest.
FAN_BITS = 4
DIGEST = 64

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_of(*fields: Column) -> Column:
    """Digest of a row's fields, each with its length before it, so that no two rows read alike."""
    texts = [f.cast("string") for f in fields]
    return digest_of(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def siblings(step: Column) -> Column:
    """The digests beside a node's own in the preimage of its parent."""
    return F.concat(_left(step), _right(step))


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and the steps (preimage, slot) from its run to the root."""
    return F.aggregate(path, leaf, lambda node, step: digest_of(F.concat(_left(step), node, _right(step))))


def _left(step: Column) -> Column:
    return F.substr(step["preimage"], F.lit(1), step["slot"] * DIGEST)


def _right(step: Column) -> Column:
    return F.substr(step["preimage"], (step["slot"] + 1) * DIGEST + 1)


def _slot(pos: Column) -> Column:
    return pos.bitwiseAND((1 << FAN_BITS) - 1).cast("int")


def _above(pos: Column) -> Column:
    return F.shiftright(pos, FAN_BITS)


def _parents(count: Column) -> Column:
    return _above(count + (1 << FAN_BITS) - 1)


@dataclass(frozen=True)
class Manifest:
    """``runs`` (tree, size, pos, children, preimage, digest, count) are the lowest parents, ``levels`` those above
    them (tree, pos, count, preimage, digest), ``trees`` (source, size, tree) the sources in order, ``roots`` (tree,
    subroot) what each ends in, ``crown`` the levels over these, and ``root`` the last digest."""

    runs: DataFrame
    levels: list[DataFrame]
    trees: DataFrame
    roots: DataFrame
    crown: list[DataFrame]
    root: str | None


def _sorted(rows: DataFrame, *keys: str) -> DataFrame:
    """A written table in the order of ``keys``; ``at`` is the range in its upper bits and the row below them."""
    return cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))


def _range() -> Column:
    return F.shiftright("at", 33).alias("range")


def build(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves`` (doc_id, source, leaf, and columns to carry along)."""
    carried = [c for c in leaves.columns if c != "source"]
    rows = _sorted(cut(leaves), "source", "doc_id", "leaf")
    # One row for each range and source: as many as there are ranges and sources together.
    pieces = cut(rows.groupBy(_range(), "source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")))

    ordered = _sorted(pieces.groupBy("source").agg(F.sum("n").alias("size")), "source")
    starts = ordered.groupBy(_range()).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    sofar = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = starts.withColumn("before", F.coalesce(F.sum("n").over(sofar), F.lit(0)))
    trees = cut(ordered.withColumn("range", _range()).join(starts, "range").select("source", "size", (F.col("before") + F.col("at") - F.col("first")).alias("tree")))

    sofar = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.withColumn("before", F.coalesce(F.sum("n").over(sofar), F.lit(0))).alias("p").join(trees.alias("t"), F.expr("p.source <=> t.source"))
    offsets = offsets.select("range", F.col("p.source").alias("source"), "tree", "size", (F.col("before") - F.col("first")).alias("shift"))
    placed = rows.withColumn("range", _range()).alias("r").join(offsets.alias("o"), F.expr("r.range = o.range AND r.source <=> o.source"))
    pos = F.col("at") + F.col("shift")
    child = F.struct(_slot(pos).alias("slot"), *(F.col(f"r.{c}").alias(c) for c in carried))
    runs = placed.groupBy("tree", "size", _above(pos).alias("pos")).agg(F.sort_array(F.collect_list(child)).alias("children"))
    runs = runs.withColumn("preimage", F.array_join(F.transform("children", lambda c: c["leaf"]), ""))
    alone = F.col("size") == 1
    runs = cut(runs.withColumns({"digest": F.when(alone, F.col("preimage")).otherwise(digest_of(F.col("preimage"))), "count": _parents(F.col("size"))}))

    most = trees.agg(F.max("size"), F.count(F.lit(1))).first()
    levels, roots = _levels(runs, -(-(most[0] or 0) >> FAN_BITS))
    roots = cut(roots.select("tree", F.col("digest").alias("subroot")))
    tops = roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(most[1]).alias("count"), F.col("subroot").alias("digest"))
    crown, last = _levels(tops, most[1])
    root = last.first()
    return Manifest(runs, levels, trees, roots, crown, root and root["digest"])


def _levels(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels over ``nodes`` (tree, pos, count, digest), of which a tree has ``most``; and each tree's last node."""
    levels, lasts = [], []
    nodes = nodes.select("tree", "pos", "count", "digest")
    while True:
        lasts.append(nodes.filter("count = 1").select("tree", "digest"))
        if most <= 1:
            return levels, functools.reduce(DataFrame.union, lasts)
        child = F.struct(_slot(F.col("pos")).alias("slot"), "digest")
        parents = nodes.filter("count > 1").groupBy("tree", "count", _above(F.col("pos")).alias("up")).agg(F.sort_array(F.collect_list(child)).alias("children"))
        parents = parents.select("tree", F.col("up").alias("pos"), _parents(F.col("count")).alias("count"), F.array_join("children.digest", "").alias("preimage"))
        levels.append(cut(parents.withColumn("digest", digest_of(F.col("preimage")))))
        nodes, most = levels[-1].select("tree", "pos", "count", "digest"), -(-most >> FAN_BITS)


def _paths(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``nodes`` (tree, pos, count, ...) with ``path``, the steps from each up to the root, and what ``tops`` says of
    their trees; ``tops`` has the path from a tree's last node on."""
    said = [c for c in tops.columns if c != "tree"]
    above = None
    for rows in [*reversed(levels), nodes]:
        own = [c for c in rows.columns if c != "digest" or rows is nodes]
        placed = rows.select(*own).filter("count = 1").join(tops, "tree")
        if above is not None:
            up = above.select("tree", F.col("pos").alias("up"), F.col("preimage").alias("over"), *said)
            inner = rows.select(*own, _above(F.col("pos")).alias("up")).filter("count > 1").join(up, ["tree", "up"])
            step = F.struct(F.col("over").alias("preimage"), _slot(F.col("pos")).alias("slot"))
            inner = inner.withColumn("path", F.concat(F.array(step), "path"))
            placed = placed.select(*own, *said).union(inner.select(*own, *said))
        above = placed
    return above


def proofs(m: Manifest) -> DataFrame:
    """A row for every leaf: the columns it carries, ``subroot``, and ``path``, its steps (preimage, slot) to the root."""
    none = F.array().cast("array<struct<preimage:string,slot:int>>")
    crown = m.runs.sparkSession.createDataFrame([(0,)], "tree long").select("tree", none.alias("path"))
    tops = m.roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(1).cast("long").alias("one"), "subroot")
    counted = tops.join(m.trees.agg(F.count(F.lit(1)).alias("count")).withColumn("tree", F.lit(0).cast("long")), "tree")
    roots = _paths(counted.select("tree", "pos", "count", "subroot"), m.crown, crown).select(F.col("pos").alias("tree"), "subroot", "path")
    runs = _paths(m.runs.select("tree", "size", "pos", "count", "children", "preimage"), m.levels, roots)
    leaves = runs.select("size", "preimage", "subroot", "path", F.explode("children").alias("child"))
    own = F.array(F.struct("preimage", F.col("child.slot").alias("slot")))
    path = F.when(F.col("size") == 1, F.col("path")).otherwise(F.concat(own, "path"))
    carried = [c for c in leaves.schema["child"].dataType.names if c != "slot"]
    return leaves.select(*(F.col(f"child.{c}").alias(c) for c in carried), "subroot", path.alias("path"))


def lowered(text: Column) -> Column:
    """``text`` with A-Z, and no other letters, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(table(spark, sf_dir, "documents"))


def checked(docs: DataFrame) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and what folding finds where every fifth text was tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = leaf_of(*(lowered(F.col(f)) if f == "text" else F.col(f) for f in FIELDS))
    m = build(docs.select("doc_id", "source", leaf_of(*map(F.col, FIELDS)).alias("leaf"), F.when(tampered, other).alias("changed")))
    rows = proofs(m)
    root = F.lit(m.root).cast("string")
    steps = F.array_join(F.transform("path", siblings), "")
    found = rows.select("doc_id", "leaf", "subroot", root.alias("root"), digest_of(steps).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(leaf_levels: int = 6, source_levels: int = 4) -> str:
    """The same in DuckDB, for up to 16 ** levels leaves of a source and sources."""

    def levels(name: str, count: int) -> str:
        """name0 (tree, pos, digest, n) and the levels over it; a level of one node is the one below it."""
        out = ""
        for k in range(count):
            out += f"""
            {name}p{k} AS (SELECT tree, pos // 16 AS pos, max(n) AS n, string_agg(digest, '' ORDER BY pos) AS preimage FROM {name}{k} GROUP BY tree, pos // 16),
            {name}{k + 1} AS (SELECT tree, pos, CASE WHEN n > 1 THEN sha256(preimage) ELSE preimage END AS digest, (n + 15) // 16 AS n FROM {name}p{k}),"""
        return out

    def steps(rows: str, tree: str, at: str, name: str, count: int) -> str:
        """``rows`` with the proof and the folded digest taken over the levels of ``name``."""
        out = ""
        for k in range(count):
            left, right = f"substr(p.preimage, 1, 64 * (r.{at} // {16**k} % 16))", f"substr(p.preimage, 64 * (r.{at} // {16**k} % 16) + 65)"
            out += f"""
            {rows}{name}{k} AS (
                SELECT r.* REPLACE (r.proof || CASE WHEN p.n > 1 THEN {left} || {right} ELSE '' END AS proof, CASE WHEN p.n > 1 THEN sha256({left} || r.node || {right}) ELSE r.node END AS node)
                FROM {rows if k == 0 else f"{rows}{name}{k - 1}"} r JOIN {name}p{k} p ON p.tree = {tree} AND p.pos = r.{at} // {16 ** (k + 1)}),"""
        return out

    def leaf(text: str) -> str:
        fields = ", ".join(f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in (*FIELDS[:-1], text))
        return f"sha256(concat({fields}))"

    return f"""
    WITH crc_table AS (
        SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    crc AS (
        SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
        FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table),
    leaves AS (
        SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN crc % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
        FROM documents LEFT JOIN crc USING (doc_id)),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n,
            dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree
        FROM leaves),
    a0 AS (SELECT tree, place AS pos, leaf AS digest, n FROM placed),{levels("a", leaf_levels)}
    b0 AS (SELECT 0 AS tree, tree AS pos, digest, count(*) OVER () AS n FROM a{leaf_levels}),{levels("b", source_levels)}
    r AS (SELECT *, '' AS proof, coalesce(changed, leaf) AS node FROM placed),{steps("r", "r.tree", "place", "a", leaf_levels)}{steps(f"ra{leaf_levels - 1}", "0", "tree", "b", source_levels)}
    done AS (SELECT * FROM ra{leaf_levels - 1}b{source_levels - 1})
    SELECT done.doc_id, leaf, a.digest AS subroot, b.digest AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = b.digest AS verified
    FROM done JOIN a{leaf_levels} a ON a.tree = done.tree CROSS JOIN b{source_levels} b
    """


OP11_SQL = _sql()

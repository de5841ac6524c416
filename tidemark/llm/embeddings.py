"""Near-duplicate embeddings with a robust-pruned flat graph.

Centroids of a bounded sample deal the vectors to shards that overlap; a shard links each of its vectors to near
ones that no closer pick already covers (robust pruning).  The shards' adjacency lists are united, every vector is
searched for from its home shard's medoid, and from the place found the search widens over the graph as long as it
meets vectors near the range.  What is near is decided in double precision.

A task gives each of its vectors' number of links and folds the links themselves to a forest, so a group in which
every vector is linked with every other costs one row per vector.  An audit compares the numbers with brute force
over all rows, for the vectors whose id is divisible by 50 (at most AUDIT_QUERIES of them, chosen by a hash), and
widens the overlap until the recall is reached.  If no overlap reaches it, all pairs of blocks are compared.

Equal vectors are one node with a count.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths never link; rows that repeat a vec_id count as other vectors of the same id; a null vec_id gets a
row of its own without links; other columns (labels) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.session import cut, ship_package, table

COSINE = 0.9
#: Vectors a shard should hold, sampled vectors for the centroids, picks per vector, and the pruning factor.
SHARD, SAMPLE, DEGREE, ALPHA = 4000, 8192, 16, 1.2
#: How much worse than its best a centroid may be to get the vector as well; tried in turn until the audit is passed.
MARGINS = (0.1, 0.25)
#: The search widens over vectors at least this near.
WIDEN = COSINE - 0.15
AUDIT_QUERIES, RECALL = 2000, 0.999
#: Vectors of a block, when all pairs of blocks are compared.
BLOCK = 2000


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """(id, copies, v): usable distinct vectors with their smallest vec_id."""
    ok = F.size("embedding") > 0
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.exists("embedding", lambda x: x != 0)
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok).filter(finite & norm)
    return rows.groupBy(F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v")).agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "copies", "v")


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(nodes: DataFrame, count: int, dim: int) -> np.ndarray:
    """``count`` unit centroids of at most SAMPLE vectors of one length, by a few rounds of spherical k-means."""
    sample = nodes.filter(F.size("v") == dim).orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").collect()
    x = _unit([r["v"] for r in sample])
    c = x[np.linspace(0, len(x) - 1, min(count, len(x))).astype(int)]
    for _ in range(8):
        near = (x @ c.T).argmax(axis=1)
        for k in range(len(c)):
            if (near == k).any():
                c[k] = x[near == k].sum(axis=0)
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def deal(nodes: DataFrame, shards: dict[int, np.ndarray], margin: float) -> DataFrame:
    """(shard, id, copies, v, home): every vector in its nearest shard, which is its home, and in those almost as near."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies, vs = (batch.column(k).to_pylist() for k in range(3))
            out: list[tuple] = []
            for dim in {len(v) for v in vs}:
                of = [k for k, v in enumerate(vs) if len(v) == dim]
                near = _unit([vs[k] for k in of]) @ shards[dim].T
                best = near.argmax(axis=1)
                rows, cols = np.nonzero(near >= near.max(axis=1, keepdims=True) - margin)
                out += [(dim * 1_000_000 + int(c), ids[of[r]], copies[of[r]], vs[of[r]], bool(best[r] == c)) for r, c in zip(rows, cols, strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["shard", "id", "copies", "v", "home"])

    return nodes.select("id", "copies", "v").mapInArrow(dealt, "shard bigint, id bigint, copies bigint, v array<double>, home boolean")


def robust_picks(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """For every row, near rows such that none is ``alpha`` times nearer to an earlier pick than to the row."""
    picks = []
    for at in range(0, len(x), 512):
        near = x[at : at + 512] @ x.T
        wide = min(len(x), 6 * degree)
        order = np.argpartition(-near, wide - 1, axis=1)[:, :wide]
        for k, candidates in enumerate(order):
            me = at + k
            candidates = candidates[candidates != me]
            apart = np.sqrt(np.maximum(0, 2 - 2 * near[k, candidates]))
            candidates = candidates[np.argsort(apart, kind="stable")]
            apart = np.sort(apart, kind="stable")
            between = np.sqrt(np.maximum(0, 2 - 2 * x[candidates] @ x[candidates].T))
            alive, chosen = np.ones(len(candidates), bool), []
            for j in range(len(candidates)):
                if alive[j]:
                    chosen.append(candidates[j])
                    if len(chosen) == degree:
                        break
                    alive &= alpha * between[j] > apart
            picks.append(np.array(chosen, np.int64))
    return picks


def _shard_edges(rows: pd.DataFrame) -> pd.DataFrame:
    ids, x = rows["id"].to_numpy(), _unit(rows["v"])
    # Edges go both ways, and the row order is chained, so that every vector of a shard can be reached.
    pairs = {(a, int(b)) for a, picked in enumerate(robust_picks(x)) for b in picked}
    pairs |= {(k, k + 1) for k in range(len(ids) - 1)}
    pairs |= {(b, a) for a, b in pairs}
    a, b = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
    return pd.DataFrame({"id": ids[a], "other": ids[b], "near": (x[a] * x[b]).sum(axis=1) >= WIDEN})


_FOUND = "id bigint, n bigint, root bigint"


class _Forest:
    """Components of a task's rows, and what the task gives of them."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def link(self, row: int, others: np.ndarray) -> None:
        for other in np.unique(self.label[others]):
            if other != self.label[row]:
                low, high = sorted((other, self.label[row]))
                self.label[self.label == high] = low

    def rows(self, ids: np.ndarray, n: np.ndarray, counted: np.ndarray) -> pd.DataFrame:
        """_FOUND: n, or null where the row was not counted here, and the smallest id that the row is linked with."""
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, self.label, ids)
        out = pd.DataFrame({"id": ids, "n": pd.array(np.where(counted, n, 0), "Int64"), "root": least[self.label]})
        out.loc[~counted, "n"] = pd.NA
        return out[counted | (out["root"] != out["id"])]


def _search(rows: pd.DataFrame) -> pd.DataFrame:
    """_FOUND of the vectors whose home this shard is: greedy steps from the medoid, then widening over the range."""
    ids, copies, x = rows["id"].to_numpy(), rows["copies"].to_numpy(), _unit(rows["v"])
    place = {int(i): k for k, i in enumerate(ids)}
    around = [np.array([place[int(o)] for o in others if int(o) in place], np.int64) for others in rows["others"]]
    medoid = int((x @ x.mean(axis=0)).argmax())
    n, forest = np.zeros(len(ids), np.int64), _Forest(len(ids))
    home = rows["home"].to_numpy()
    for q in np.flatnonzero(home):
        at, score = medoid, float(x[medoid] @ x[q])
        while len(around[at]):
            s = x[around[at]] @ x[q]
            if s.max() <= score:
                break
            at, score = int(around[at][s.argmax()]), float(s.max())
        todo = np.unique([at, q])
        seen = np.zeros(len(ids), bool)
        seen[todo] = True
        linked = [todo[x[todo] @ x[q] >= COSINE]]
        while len(todo):
            new = np.unique(np.concatenate([around[t] for t in todo]))
            new = new[~seen[new]]
            seen[new] = True
            s = x[new] @ x[q]
            linked.append(new[s >= COSINE])
            todo = new[s >= WIDEN]
        found = np.concatenate(linked)
        found = found[found != q]
        n[q] = copies[found].sum()
        forest.link(q, found)
    return forest.rows(ids, n, home)


def graph_links(nodes: DataFrame, dims: dict[int, int], margin: float) -> DataFrame:
    """_FOUND by the search over the united graph; every id has one row with n."""
    shards = {dim: centroids(nodes, max(1, -(-n // SHARD)), dim) for dim, n in dims.items()}
    dealt = cut(deal(nodes, shards, margin))
    edges = dealt.groupBy("shard").applyInPandas(_shard_edges, "id bigint, other bigint, near boolean")
    united = edges.groupBy("id").agg(F.collect_set("other").alias("others"), F.collect_set(F.when(F.col("near"), F.col("other"))).alias("near"))
    united = cut(united)
    # A shard is searched with its own vectors and those that the united lists of its vectors lead to by a near edge;
    # far edges only serve the greedy steps inside the shard.
    led = dealt.select("shard", "id").join(united.filter(F.size("near") > 0), "id").select("shard", F.explode("near").alias("id")).distinct()
    beyond = led.join(dealt.select("shard", "id"), ["shard", "id"], "left_anti").join(nodes.select("id", "copies", "v"), "id")
    rows = dealt.unionByName(beyond.withColumn("home", F.lit(False))).join(united.drop("near"), "id", "left")
    rows = rows.withColumn("others", F.coalesce("others", F.array().cast("array<bigint>"))).select("shard", "id", "copies", "v", "home", "others")
    return rows.groupBy("shard").applyInPandas(_search, _FOUND)


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """_FOUND of one pair of blocks, or of one block with itself."""
    ids, copies, block, x = rows["id"].to_numpy(), rows["copies"].to_numpy(), rows["block"].to_numpy(), _unit(rows["v"])
    apart, n, forest = bool(rows["apart"].iloc[0]), np.zeros(len(ids), np.int64), _Forest(len(ids))
    for q in range(len(ids)):
        near = x @ x[q] >= COSINE
        near[q] = False
        if apart:
            near &= block != block[q]
        found = np.flatnonzero(near)
        n[q] = copies[found].sum()
        forest.link(q, found)
    return forest.rows(ids, n, n > 0)


def exact_links(nodes: DataFrame, dims: dict[int, int]) -> DataFrame:
    """_FOUND by comparing all pairs of blocks; an id has one row with n for every block that holds links of it."""
    blocks = F.lit(1)
    for dim, n in dims.items():
        blocks = F.when(F.size("v") == dim, F.lit(-(-n // BLOCK))).otherwise(blocks)
    dealt = nodes.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = F.xxhash64(F.size("v"), F.least("block", "other"), F.greatest("block", "other"))
    rows = dealt.select(key.alias("part"), (F.col("block") != F.col("other")).alias("apart"), "block", "id", "copies", "v")
    return rows.groupBy("part").applyInPandas(_compare, _FOUND)


def audit(nodes: DataFrame, found: DataFrame) -> float:
    """Mean share of a query's true links, counted against all rows in blocks, that ``found`` has.

    The queries are the vectors whose id is divisible by 50, at most AUDIT_QUERIES; each that has links counts alike.
    """
    queries = nodes.filter("id % 50 = 0").orderBy(F.xxhash64("id")).limit(AUDIT_QUERIES).select("id", "v").collect()
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(r["v"]) for r in queries}:
        of = [r for r in queries if len(r["v"]) == dim]
        by_dim[dim] = (np.array([r["id"] for r in of]), _unit([r["v"] for r in of]))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies, vs = (batch.column(k).to_pylist() for k in range(3))
            ids, copies = np.array(ids), np.array(copies)
            for dim, (qid, q) in by_dim.items():
                of = [k for k, v in enumerate(vs) if len(v) == dim]
                if of:
                    near = (_unit([vs[k] for k in of]) @ q.T >= COSINE) & (ids[of][:, None] != qid)
                    yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array((near * copies[of][:, None]).sum(axis=0))], ["id", "expected"])

    if not queries:
        return 1.0
    truth = nodes.select("id", "copies", "v").mapInArrow(counted, "id bigint, expected bigint").groupBy("id").agg(F.sum("expected").alias("expected")).filter("expected > 0")
    got = found.groupBy("id").agg(F.sum("n").alias("n"))
    share = truth.join(got, "id", "left").agg(F.avg(F.least(F.coalesce("n", F.lit(0)) / F.col("expected"), F.lit(1.0)))).first()[0]
    return 1.0 if share is None else share


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``."""
    ship_package(vectors.sparkSession)
    nodes = cut(clean_vectors(vectors))
    dims = {r["dim"]: r["n"] for r in nodes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    for margin in MARGINS:
        found = cut(graph_links(nodes, dims, margin))
        if audit(nodes, found) >= RECALL:
            break
    else:
        found = cut(exact_links(nodes, dims))
    counts = found.groupBy("id").agg(F.sum("n").alias("others"))
    components = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = nodes.join(counts, "id", "left").join(components, "id", "left")
    known = known.select("v", F.coalesce("component", "id").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"))
    keyed = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    out = keyed.join(known, "v", "left")
    usable = F.col("vec_id").isNotNull() & F.col("n").isNotNull()
    component = F.when(usable, F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(usable, F.col("n")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )


def op1_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))

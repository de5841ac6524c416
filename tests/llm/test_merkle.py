"""The manifest against a plain tree, against its SQL, and with odd rows."""

import hashlib
import zlib

import pytest
from conftest import same_rows

from tidemark.llm import merkle

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, path string, at string, n string, pos string, tree string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    text = row["text"]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def tree(digests):
    """The last digest, and for every leaf its steps (digests before it, digests behind it)."""
    steps = [[] for _ in digests]
    under = [[k] for k in range(len(digests))]
    while len(digests) > 1:
        runs = [range(k, min(k + 16, len(digests))) for k in range(0, len(digests), 16)]
        for run in runs:
            for k in run:
                for x in under[k]:
                    steps[x].append(("".join(digests[run.start : k]), "".join(digests[k + 1 : run.stop])))
        under = [[x for k in run for x in under[k]] for run in runs]
        digests = [h("".join(digests[k] for k in run)) for run in runs]
    return digests[0], steps


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    sub = []
    for s in sources:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        sub.append(tree([leaf(r) for r in by[s]]))
    root, crown = tree([top for top, _ in sub])
    out = []
    for s, (top, steps), over in zip(sources, sub, crown, strict=True):
        for r, own in zip(by[s], steps, strict=True):
            path = own + over
            node = leaf(r, lower=r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            for before, behind in path:
                node = h(before + node + behind)
            out.append((r["doc_id"], leaf(r), top, root, h("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 2, 16, 17, 300], [1] * 40, [260] + [3] * 18])
def test_against_a_plain_tree(spark, sizes):
    rows = [(k * 31 % 1009 + 1000 * s, f"Text {k} É" if k % 7 else None, "en" if k % 3 else None, None if s == 2 else f"src{s}é" if s % 2 else f"SRC{s}", k if k % 5 else None, "x", None, "y", "z", "u", "v") for s, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    assert sorted((tuple(r) for r in merkle.checked(docs).collect()), key=str) == plain([r.asDict() for r in docs.collect()])


def test_odd_rows(spark):
    rows = [(1, "A"), (1, "A"), (1, "B"), (None, "C"), (None, None), (2, ""), (3, "Word " * 50_000), (5, "lower")]
    docs = spark.createDataFrame([(i, t, None, s, 1, "x", "x", "x", "x", "x", "x") for i, t in rows for s in (None, "", "a")], COLUMNS)
    got = sorted((tuple(r) for r in merkle.checked(docs).collect()), key=str)
    assert got == plain([r.asDict() for r in docs.collect()])
    assert len(got) == 24


def test_only_changed_texts_fail(spark, sf_dir, duck):
    out = merkle.op11_merkle_manifest(spark, sf_dir)
    same_rows(out, duck.execute(merkle.OP11_SQL))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in out.collect():
        touched = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in texts[r["doc_id"]])
        assert r["verified"] != touched


def test_preimages_are_stored(spark):
    docs = spark.createDataFrame([(k, f"t{k}", "en", "s", 1) for k in range(40)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    m = merkle.build(docs.select("doc_id", "source", merkle.leaf_of(*(docs[c] for c in merkle.FIELDS)).alias("leaf")))
    assert [r["size"] for r in m.runs.collect()] == [40] * 3
    assert all(r["digest"] == h(r["preimage"]) for rows in (m.runs, *m.levels) for r in rows.collect())
    assert [rows.count() for rows in m.levels] == [1] and m.crown == [] and m.root == m.levels[0].first()["digest"]

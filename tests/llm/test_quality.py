"""The field against sums over all labellings, its accuracy on held-out rows, and odd rows."""

import itertools
import math
import os
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import quality
from tidemark.session import table

COLUMNS = "doc_id bigint, text string, score string, predicted string, quality string, x string, held_out string"


@pytest.mark.parametrize("n", [1, 2, 5])
def test_marginals_against_all_labellings(n):
    rng = random.Random(n)
    e, ties = [rng.gauss(0, 2) for _ in range(n)], tuple(rng.gauss(0, 2) for _ in range(4))
    weight = {y: math.exp(sum(a for a, b in zip(e, y, strict=True) if b) + sum(ties[2 * a + b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=n)}
    want = [sum(w for y, w in weight.items() if y[k]) / sum(weight.values()) for k in range(n)]
    assert np.allclose(quality.marginals(e, ties), want)


def test_loss_and_gradient_against_all_labellings():
    rng = np.random.default_rng(3)
    groups = [(rng.normal(size=(3, n, quality.FEATURES)), np.array([1.0, 0.0, 1.0])) for n in (1, 3)]
    at = rng.normal(size=quality.FEATURES + 4) / 4
    w, t = at[:-4], at[-4:].reshape(2, 2)

    def score(x, y):
        return sum(float(x[k] @ w) for k in range(len(y)) if y[k]) + sum(t[a, b] for a, b in itertools.pairwise(y))

    want = quality.RIDGE / 2 * at @ at
    for xs, ys in groups:
        for x, y in zip(xs, ys, strict=True):
            want += math.log(sum(math.exp(score(x, z)) for z in itertools.product((0, 1), repeat=len(x)))) - score(x, [int(y)] * len(x))
    loss, grad = quality._loss(at, groups)
    assert np.isclose(loss, want)
    for k in (0, 7, quality.FEATURES - 1, quality.FEATURES, quality.FEATURES + 3):
        step = np.eye(len(at))[k] * 1e-5
        assert np.isclose((quality._loss(at + step, groups)[0] - quality._loss(at - step, groups)[0]) / 2e-5, grad[k], rtol=1e-4, atol=1e-5)


def test_fit_lowers_the_loss():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 4, quality.FEATURES))
    groups = [(x, (x[:, :, 0].mean(axis=1) > 0).astype(float))]
    at = quality.fitted(groups)
    assert quality._loss(at, groups)[0] < 0.2 * quality._loss(np.zeros_like(at), groups)[0]
    assert np.abs(quality._loss(at, groups)[1]).max() < 0.5


@pytest.fixture
def larger(sf_dir):
    """The tables next in size, with labels enough to learn from."""
    return os.path.join(os.path.dirname(sf_dir), "sf0.01")


def test_held_out_rows(spark, larger):
    sf_dir = larger
    rows = quality.op12_line_quality(spark, sf_dir)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = rows.join(table(spark, sf_dir, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)


def test_held_out_labels_are_never_read(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    turned = labels.withColumn("quality", quality.F.when(quality.fold(labels["doc_id"]) == 2, 1 - labels["quality"]).otherwise(labels["quality"]))
    assert quality.fit(docs, labels) == quality.fit(docs, turned)


def test_neighbours_matter(spark, larger):
    docs, labels = table(spark, larger, "documents"), table(spark, larger, "labels")
    field = quality.fit(docs, labels)
    fine = "The stone was on the hill and they went with it."
    menu = "home | news | about | help | login | cart"
    made = spark.createDataFrame([(1, "\n".join([fine] * 5)), (2, "\n".join([menu, menu, fine, menu, menu])), (3, "\n".join([menu] * 5))], "doc_id bigint, text string")
    by = {(r["doc_id"], r["line"]): r["good"] for r in quality.line_labels(made, field).collect()}
    assert by[1, 2] > by[2, 2] > by[3, 2]
    got = {r["doc_id"]: r["score"] for r in quality.score(made, field).collect()}
    assert got[1] > got[2] > got[3]


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "\n\n \t\n"), (4, "word " * 60_000), (5, "a\n" * 30_000), (5, "a\n" * 30_000), (None, "a text. And more."), (6, "x" * 300_000)]
    docs = spark.createDataFrame([(i, t, *"abcde") for i, t in texts], COLUMNS)
    labels = spark.createDataFrame([(4, 0), (4, 1), (5, 1), (None, 1), (2, None), (3, 1), (1, 1), (6, 0), (99, 1)], "doc_id bigint, quality int")
    field = quality.fit(docs, labels)
    out = quality.score(docs, field)
    assert out.columns == ["doc_id", "text", "quality", "x", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert quality.score(docs.limit(0), field).collect() == []
    none = quality.fit(docs, labels.filter("quality = 1"))
    assert none.weights == () and quality.document_score("any", none) == none.share > 0.5
    assert quality.fit(docs, labels.limit(0)).share == 0.5


def test_blocks_add_up(monkeypatch):
    line = "One two, two THREE | four!! " * 50
    whole, n = quality.measured(line)
    monkeypatch.setattr(quality, "BLOCK", 40)
    parts, m = quality.measured(line)
    assert n == m and [whole[k] for k in (0, 1, 2, 3, 4, 8, 9)] == pytest.approx([parts[k] for k in (0, 1, 2, 3, 4, 8, 9)])

"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  What speaks for either are features of the line (letter case, symbols, separators,
repetition, length) and of the lines before and behind it; the chain's transitions tie neighbouring labels.  The
field is fitted to labelled documents, all lines of which carry the document's label, by maximum likelihood.  A
document's score is the mean, weighted by the lines' lengths, of the forward-backward marginals for good.

Only the documents' text enters a score.  At most TRAINING_DOCS labelled documents, chosen by a hash of their id, and
of each at most TRAINING_LINES lines from evenly spread places, are used to fit, so what reaches the driver of them
is bounded; everything is scored, and scored whole.

Cases: a null or empty text is one empty line and is scored as such; blank lines are lines of weight one; texts and
lines of any length are read whole (repetition is counted inside blocks of BLOCK characters); labels that are null
are not used, repeated ones count once (bad if any says so); of rows that repeat a doc_id the smallest text is used
to fit, and every row is scored; without usable labels of both kinds the score is the smoothed share of good labels;
a null doc_id is not held out and never used to fit; other columns are passed through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut, ship_package, table

TRAINING_DOCS, TRAINING_LINES = 4_000, 200
BLOCK = 1 << 16
RIDGE = 1.0
GOOD_FROM = 0.7

_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
_DIGITS, _SYMBOLS = b"0123456789", b"#$%&*+/<=>@[\\]^_`{|}~"
_ENDS = tuple(".!?\"')”»")
#: Features of a line alone; ``joined`` adds those of its neighbours.
OWN = 15


def measured(line: str) -> tuple[list[float], int]:
    """Features of one line, and its length."""
    letters = upper = digits = symbols = shouts = words = again = distinct = thrice = apart = odd = characters = 0
    start, n = 0, len(line)
    while start < n:
        end = start + BLOCK
        end = n if end >= n else (line.find(" ", end) + 1 or n)
        block = line[start:end]
        raw = block.encode("utf-8", "surrogatepass")
        size = len(raw)
        letters += size - len(raw.translate(None, _LETTERS))
        upper += size - len(raw.translate(None, _UPPER))
        digits += size - len(raw.translate(None, _DIGITS))
        symbols += size - len(raw.translate(None, _SYMBOLS))
        shouts += raw.count(b"!")
        names = block.split()
        words += len(names)
        characters += sum(map(len, names))
        again += sum(map(str.__eq__, names, names[1:]))
        distinct += len(set(names))
        thrice += max(0, len(names) - 2) - len(set(zip(names, names[1:], names[2:], strict=False)))
        odd += sum(not w[-1].isalnum() and w[-1] not in ".,;:!?)\"'”»’…" for w in names)
        apart += sum(len(w) == 1 and not w.isalnum() for w in names)
        start = end
    w, c = max(words, 1), max(characters, 1)
    return [
        upper / max(letters, 1), digits / c, min(1.0, 4 * symbols / c), min(1.0, 4 * shouts / c), apart / w, again / w, (words - distinct) / w, thrice / w, odd / w, min(1.0, c / w / 16),
        float(line.rstrip().endswith(_ENDS)), float(words < 5), min(1.0, math.log1p(n) / 12), float(not words), float(upper > 0.5 * letters and letters > 3),
    ], max(n, 1)


def described(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The lines' own features, and the lines' lengths."""
    rows = [measured(line) for line in (text or "").split("\n")]
    return np.array([f for f, _ in rows]), np.array([float(n) for _, n in rows])


def joined(own: np.ndarray) -> np.ndarray:
    """Features of the lines with those of the lines before and behind, and flags for the text's ends."""
    none = np.zeros((1, OWN))
    before, behind = np.vstack([none, own[:-1]]), np.vstack([own[1:], none])
    flags = np.zeros((len(own), 4))
    flags[0, 0] = flags[-1, 1] = flags[:, 3] = 1.0
    flags[1:, 2] = (own[1:] == own[:-1]).all(axis=1)
    return np.hstack([own, before, behind, flags])


FEATURES = 3 * OWN + 4


@dataclass(frozen=True)
class Field:
    """``weights`` for the log-odds of good by a line's features, and ``ties``, the scores of bad-bad, bad-good,
    good-bad and good-good; without weights, ``share`` is everyone's score."""

    weights: tuple[float, ...]
    ties: tuple[float, float, float, float]
    share: float = 0.5


def marginals(emissions: list[float], ties: tuple[float, float, float, float]) -> list[float]:
    """P(good) of every line by forward and backward log-odds."""
    bb, bg, gb, gg = ties
    ahead = [0.0] * len(emissions)
    for t in range(1, len(emissions)):
        x = ahead[t - 1] + emissions[t - 1]
        ahead[t] = _log_sum(x + gg, bg) - _log_sum(x + gb, bb)
    out, back = [0.0] * len(emissions), 0.0
    for t in range(len(emissions) - 1, -1, -1):
        x = back + emissions[t]
        z = ahead[t] + x
        out[t] = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
        back = _log_sum(x + gg, gb) - _log_sum(x + bg, bb)
    return out


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def document_score(text: str | None, field: Field) -> float:
    if not field.weights:
        return field.share
    own, lengths = described(text)
    p = marginals((joined(own) @ np.array(field.weights)).tolist(), field.ties)
    return min(1.0, max(0.0, float(lengths @ np.array(p) / lengths.sum())))


def _loss(params: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray]:
    """Negative log likelihood with its gradient; ``groups`` are (documents, lines, features) of equal length with labels."""
    w, t = params[:FEATURES], params[FEATURES:].reshape(2, 2)
    loss, grad = RIDGE / 2 * float(params @ params), RIDGE * params
    for x, y in groups:
        n, length, _ = x.shape
        e = x @ w
        ahead = np.zeros((length, n, 2))
        back = np.zeros((length, n, 2))
        own = np.stack([np.zeros_like(e), e], axis=2)  # documents, lines, labels
        for k in range(1, length):
            ahead[k] = np.logaddexp.reduce((ahead[k - 1] + own[:, k - 1])[:, :, None] + t, axis=1)
        for k in range(length - 2, -1, -1):
            back[k] = np.logaddexp.reduce((back[k + 1] + own[:, k + 1])[:, None, :] + t, axis=2)
        z = np.logaddexp.reduce(ahead[-1] + own[:, -1], axis=1)
        p = np.exp(ahead + back + own.transpose(1, 0, 2) - z[None, :, None])[:, :, 1].T
        loss += float((z - y * (e.sum(axis=1) + (length - 1) * t[1, 1]) - (1 - y) * (length - 1) * t[0, 0]).sum())
        grad[:FEATURES] += np.einsum("nl,nlf->f", p - y[:, None], x)
        pairs = np.zeros((2, 2))
        for k in range(1, length):
            both = (ahead[k - 1] + own[:, k - 1])[:, :, None] + t + (back[k] + own[:, k])[:, None, :]
            pairs += np.exp(both - z[:, None, None]).sum(axis=0)
        pairs[1, 1] -= (length - 1) * y.sum()
        pairs[0, 0] -= (length - 1) * (1 - y).sum()
        grad[FEATURES:] += pairs.ravel()
    return loss, grad


def fitted(groups: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, memory: int = 8) -> np.ndarray:
    """The parameters of least loss, by limited-memory quasi-Newton steps."""
    at = np.zeros(FEATURES + 4)
    loss, grad = _loss(at, groups)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, back = grad.copy(), []
        for s, y in reversed(steps):
            a = s @ d / (s @ y)
            back.append(a)
            d -= a * y
        d *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.abs(grad).sum())
        for (s, y), a in zip(steps, reversed(back), strict=True):
            d += s * (a - y @ d / (s @ y))
        width = 1.0
        while True:
            after = at - width * d
            lower, slope = _loss(after, groups)
            if lower <= loss - 1e-4 * width * (grad @ d) or width < 1e-6:
                break
            width /= 2
        if not lower < loss:
            break
        s, y = after - at, slope - grad
        steps = [*steps, (s, y)][-memory:] if s @ y > 1e-10 else steps
        done = loss - lower < 1e-5 * loss
        at, loss, grad = after, lower, slope
        if done:
            break
    return at


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", limit: int = TRAINING_DOCS, lines: int = TRAINING_LINES) -> Field:
    ship_package(docs.sparkSession)
    usable = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = usable.filter(fold(F.col("doc_id")) != 2).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    used = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    used = cut(used.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")).select("text", "quality"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(0):
                own, _ = described(t.as_py())
                if len(own) > lines:  # runs of neighbours, evenly spread
                    starts = np.linspace(0, len(own) - 10, lines // 10).astype(int)
                    own = own[np.unique(starts[:, None] + np.arange(10))]
                rows.append(own.astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float32())), batch.column(1)], ["x", "quality"])

    # Bounded: at most TRAINING_DOCS rows of TRAINING_LINES lines.
    rows = used.mapInArrow(features, "x array<float>, quality int").toArrow()
    by: dict[int, list[tuple[np.ndarray, float]]] = {}
    for x, q in zip(rows.column("x"), rows.column("quality").to_pylist(), strict=True):
        own = np.array(x.as_py(), float).reshape(-1, OWN)
        by.setdefault(len(own), []).append((joined(own), float(q > 0)))
    good = sum(y for group in by.values() for _, y in group)
    n = sum(len(group) for group in by.values())
    share = (good + 0.5) / (n + 1) if n else 0.5
    if not 0 < good < n:
        return Field((), (0.0,) * 4, share)
    params = fitted([(np.stack([x for x, _ in by[k]]), np.array([y for _, y in by[k]])) for k in sorted(by)])
    return Field(tuple(params[:FEATURES].tolist()), tuple(params[FEATURES:].tolist()), share)


def score(docs: DataFrame, field: Field, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names are replaced."""
    ship_package(docs.sparkSession)
    docs = docs.drop(score, predicted)
    at, names = docs.columns.index(text), [*docs.columns, score]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [document_score(t.as_py(), field) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names)

    schema = docs.select("*", F.lit(0.0).alias(score)).schema
    return docs.mapInArrow(scored, schema).withColumn(predicted, (F.col(score) >= GOOD_FROM).cast("int"))


def line_labels(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line, length, good) for every line of every document: its place from 0 on and P(good)."""
    ship_package(docs.sparkSession)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, t in zip(batch.column(0), batch.column(1), strict=True):
                own, lengths = described(t.as_py())
                p = marginals((joined(own) @ np.array(field.weights)).tolist(), field.ties) if field.weights else [field.share] * len(own)
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * n, batch.column(0).type), pa.array(range(n), pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(p, pa.float64())], [doc_id, "line", "length", "good"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(labelled, f"`{doc_id}` {kind}, line bigint, length bigint, good double")


def op12_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, field).select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted")

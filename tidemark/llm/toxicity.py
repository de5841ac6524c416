"""Toxicity from a learned lexicon, with misspellings and quotation taken into account.

Terms (whole words and word beginnings) are learned from labelled documents.  Words of a text are read by the
Levenshtein automata of all terms at once, intersected with the lexicon's trie and made deterministic as far as the
corpus needs it.  A window of words and quotation marks around each hit separates quoting a term from using it.
A logistic model over the weighted hits gives the score.

Only the documents' text enters a score.  At most TRAINING_ROWS labelled documents, chosen by a hash of their id, are
used to fit, so what reaches the driver of their words is bounded; everything is scored.

Cases: null or empty texts get the score of a text without hits; labels that are null are not used, repeated ones
count once (toxic if any says so); of rows that repeat a doc_id the smallest text is used to fit; without usable labels of both kinds the score is the smoothed share of toxic
labels; texts of any length are read whole; a null doc_id is held out; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut, held, ship_package, table

TRAINING_ROWS = 8_000
LEXICON_TERMS = 2_000
MINIMUM_DOCS, MINIMUM_WEIGHT = 3, 2.0
STEM_LENGTHS = range(4, 9)
MEMO_WORDS, DFA_STATES = 150_000, 40_000
WINDOW = 6
WORD = re.compile(r"\w+")
#: Words that report speech or name a word, and quotation marks, of which the first ones open where nothing around
#: them tells (fixed values).
REPORTING = frozenset("said says saying called calling quote quoted quotes quoting word words term terms wrote writes dit disait mot sagte sagt wort nannte dijo dice palabra llamó".split())
OPENING, MARK = "“«„‘", re.compile("[\"“«„‘”»’]")


def tolerance(term: str) -> int:
    """Edits allowed for a whole-word term; short ones and word beginnings must fit exactly."""
    return 0 if term.endswith("*") or len(term) < 5 else 1 if len(term) < 10 else 2


class TermAutomaton:
    """Levenshtein automata of all terms run together over their trie; states are made when first met."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.allowed, self.whole, self.stem = [0], [-1], [-1]
        for k, term in enumerate(terms):
            node, path = 0, [0]
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                    self.whole.append(-1)
                    self.stem.append(-1)
                node = self.children[node][c]
                path.append(node)
            (self.stem if term.endswith("*") else self.whole)[node] = k
            for n in path:
                self.allowed[n] = max(self.allowed[n], tolerance(term))
        self.limit = [tolerance(t) for t in terms]
        self._reset()

    def _reset(self) -> None:
        self.steps: list[dict[str, int]] = []
        self.sets: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """Number of the state that holds these trie nodes with their least errors, skipped term letters included."""
        todo = list(reached)
        while todo:
            node = todo.pop()
            e = reached[node] + 1
            for child in self.children[node].values():
                if e <= self.allowed[child] and e < reached.get(child, 9):
                    reached[child] = e
                    todo.append(child)
        key = tuple(sorted(reached.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}
        for node, e in self.sets[state]:
            if e + 1 <= self.allowed[node]:
                reached[node] = min(e + 1, reached.get(node, 9))
            for label, child in self.children[node].items():
                cost = e + (label != c)
                if cost <= self.allowed[child] or (cost == e == 0):
                    reached[child] = min(cost, reached.get(child, 9))
        return self._state(reached)

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, errors) of the nearest term that ``word`` stands for."""
        if len(self.sets) > DFA_STATES:
            self._reset()
        state, stem = self.start, None
        for c in word:
            after = self.steps[state].get(c)
            if after is None:
                after = self.steps[state][c] = self._step(state, c)
            state = after
            if not self.sets[state]:
                return stem
            if stem is None:
                stem = next(((self.stem[n], 0) for n, e in self.sets[state] if not e and self.stem[n] >= 0), None)
        ends = [(e, self.whole[n]) for n, e in self.sets[state] if self.whole[n] >= 0 and e <= self.limit[self.whole[n]]]
        if ends and (stem is None or min(ends)[0] == 0):
            return min(ends)[1], min(ends)[0]
        return stem


class _Known(dict):
    def __init__(self, automaton: TermAutomaton, clean: frozenset[str]):
        self.automaton, self.clean = automaton, clean

    def __missing__(self, word: str) -> tuple[int, int] | None:
        if len(self) >= MEMO_WORDS:
            self.clear()
        found = self.automaton.find(word)
        if found and found[1] and word in self.clean:
            found = None
        self[word] = found
        return found


def opens(text: str, at: int) -> bool | None:
    """Whether the mark at ``at`` opens a quotation; None for an apostrophe."""
    before, after = text[at - 1 : at] if at else "", text[at + 1 : at + 2]
    if before.isalnum() and after.isalnum():
        return None
    free, bound = not before or before.isspace() or before in "([", not after or after.isspace()
    if free != bound:
        return free
    return text[at] in OPENING if free else not before.isalnum() and after.isalnum()


def quoted_share(text: str, words: list[re.Match], at: int) -> float:
    """How far the surroundings of the word at ``at`` speak for a quotation, 0 to 1.

    The last mark before the word must open and the first one behind it close, both within WINDOW words.
    """
    first, last = max(0, at - WINDOW), min(len(words) - 1, at + WINDOW)
    before = [x for m in MARK.finditer(text, max(0, words[first].start() - 2), words[at].start()) if (x := opens(text, m.start())) is not None]
    after = [x for m in MARK.finditer(text, words[at].end(), words[last].end() + 2) if (x := opens(text, m.start())) is not None]
    quoted = bool(before) and before[-1] and bool(after) and not after[0]
    reported = any(w.group() in REPORTING for w in words[first:at])
    return min(1.0, 0.6 * quoted + 0.4 * reported)


@dataclass(frozen=True)
class Model:
    terms: tuple[str, ...]
    weights: tuple[float, ...]
    clean: frozenset[str]
    coefficients: tuple[float, ...]


def known_words(model: Model) -> _Known:
    """What is known of words under the model's terms, kept between the tasks of this worker."""
    return held(("toxicity", model.terms, model.clean), lambda: _Known(TermAutomaton(list(model.terms)), model.clean))


def features(text: str | None, model: Model, known: dict) -> list[float]:
    """Weighted hits outside quotation: exact, misspelt; weighted hits inside quotation."""
    lowered = (text or "").lower()
    hits = [(k, found) for k, found in enumerate(map(known.__getitem__, WORD.findall(lowered))) if found]
    if not hits:
        return [0.0, 0.0, 0.0]
    words = list(WORD.finditer(lowered))
    exact = near = inside = 0.0
    for at, (term, errors) in hits:
        quoted = quoted_share(lowered, words, at)
        weight = model.weights[term]
        inside += weight * quoted
        if errors:
            near += weight * (1 - quoted)
        else:
            exact += weight * (1 - quoted)
    return [math.log1p(exact), math.log1p(near), math.log1p(inside)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Newton's method with a small ridge; the last coefficient is the intercept, which the ridge leaves alone."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    hold = np.eye(x.shape[1]) * ridge
    hold[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + hold + 1e-9 * np.eye(len(w)), x.T @ (y - p) - hold @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", limit: int = TRAINING_ROWS) -> DataFrame:
    """(text, toxic) of at most ``limit`` labelled documents outside the held-out fold."""
    usable = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = usable.filter(fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    used = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    return cut(used.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))


def _choose_terms(counts: list[tuple[str, int, float]]) -> list[tuple[str, float]]:
    """Terms (term, toxic documents, weight) that add to those before them.

    Terms that cover more come first, of equals whole words and longer beginnings.  A beginning is left out where a
    term under it already covers most of its documents, a term where it lies under a chosen beginning.
    """
    chosen: dict[str, tuple[int, float]] = {}
    under: dict[str, int] = {}
    for t, p, w in sorted(counts, key=lambda x: (-x[1] * x[2], x[0].endswith("*"), -len(x[0]), x[0])):
        stem = t.rstrip("*")
        if any(f"{stem[:k]}*" in chosen for k in STEM_LENGTHS if k <= len(stem)) or t.endswith("*") and under.get(stem, 0) >= 0.8 * p:
            continue
        chosen[t] = (p, w)
        for k in STEM_LENGTHS:
            if k <= len(stem):
                under[stem[:k]] = max(p, under.get(stem[:k], 0))
    return sorted((t, w) for t, (_, w) in chosen.items())


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    ship_package(docs.sparkSession)
    rows = training_rows(docs, labels, text)
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, fine = n.get(1, 0), n.get(0, 0)
    if not toxic or not fine:
        share = (toxic + 0.5) / (toxic + fine + 1) if toxic + fine else 0.01
        return Model((), (), frozenset(), (0.0, 0.0, 0.0, math.log(share / (1 - share))))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in seen)]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, ["term", "n", "p"])

        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = {w for w in WORD.findall((t.as_py() or "").lower()) if len(w) < 64}
                seen[y > 0].update(words)
                seen[y > 0].update({w[:k] + "*" for w in words for k in STEM_LENGTHS if len(w) > k})
                if len(seen[0]) + len(seen[1]) > MEMO_WORDS:
                    yield flush()
        yield flush()

    counts = cut(rows.mapInArrow(terms, "term string, n bigint, p bigint").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n")))
    share = toxic / (toxic + fine)
    met = F.col("p") + F.col("n")
    weight = F.log((F.col("p") + 0.5) / (toxic + 1)) - F.log((F.col("n") + 0.5) / (fine + 1))
    # A term must be further from the labels' share than chance brings any of so many terms (likelihood ratio).
    ratio = F.col("p") * F.log(F.col("p") / (met * share)) + F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / (met * (1 - share)))).otherwise(0.0)
    needed = math.log(counts.count() + 1) + 2
    fit_for = counts.filter((F.col("p") >= MINIMUM_DOCS) & (weight >= MINIMUM_WEIGHT)).filter(ratio >= needed)
    best = fit_for.orderBy(F.desc(F.col("p") * weight), "term").limit(LEXICON_TERMS)
    chosen = _choose_terms([(r["term"], r["p"], r["w"]) for r in best.select("term", "p", weight.alias("w")).collect()])
    names, weights = tuple(t for t, _ in chosen), tuple(w for _, w in chosen)

    def near_misses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TermAutomaton(list(names))
        for batch in batches:
            words = [w for w in batch.column(0).to_pylist() if (found := automaton.find(w)) and found[1]]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["term"])

    # Words near a term that toxic documents do not favour are words of their own.
    clean = counts.filter((F.col("n") > 0) & (weight < MINIMUM_WEIGHT) & ~F.col("term").endswith("*")).select("term").mapInArrow(near_misses, "term string")
    bare = Model(names, weights, frozenset(r["term"] for r in clean.collect()), ())

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words(bare)
        for batch in batches:
            x = [features(t.as_py(), bare, known) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    # Bounded: TRAINING_ROWS rows of three numbers; equal rows come as one.
    grouped = rows.mapInArrow(described, "x array<double>, toxic int").groupBy("x", "toxic").count().collect()
    x = np.repeat(np.array([r["x"] for r in grouped]), [r["count"] for r in grouped], axis=0)
    y = np.repeat(np.array([float(r["toxic"]) for r in grouped]), [r["count"] for r in grouped])
    return Model(names, weights, bare.clean, tuple(fit_logistic(x, y).tolist()))


def score(docs: DataFrame, model: Model, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names are replaced."""
    ship_package(docs.sparkSession)
    docs = docs.drop(score, predicted)
    at, names = docs.columns.index(text), [*docs.columns, score]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = model.coefficients, known_words(model)
        for batch in batches:
            z = [sum(a * b for a, b in zip(w, (*features(t.as_py(), model, known), 1.0), strict=True)) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([1 / (1 + math.exp(-max(-500.0, min(500.0, v)))) for v in z], pa.float64())], names)

    schema = docs.select("*", F.lit(0.0).alias(score)).schema
    return docs.mapInArrow(scored, schema).withColumn(predicted, (F.col(score) >= 0.5).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")

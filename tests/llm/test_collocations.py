"""Phrases against a plain count, against SQL, and with odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import same_rows

from tidemark.llm import collocations

COLUMNS = "doc_id bigint, text string, lang string, a string, n string, pos string, phrase string, score string, k string"
WORDS = ["of", "The", "the", "new", "york", "NEW", "stock", "é", "É", "x y", "a/b"]


def plain(rows, minimum, longest=5, reported=2000):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {key: a for key, a in counts.items() if a >= minimum}
    out = {}
    for (lang, p), a in found.items():
        if len(p) < 2 or any(m == lang and b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for (m, q), b in found.items()):
            continue
        cuts = [(1000 * a * n[lang] // (found[lang, p[:k]] * found[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), found[lang, p[:k]], found[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for rank, (s, a, p, x, y) in enumerate(sorted(rows)[:reported], 1))


def made(seed, n):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\r\n", ","]) for _ in range(rng.randint(0, 60)))
    return [(rng.choice(["en", "en", "de", None, "und", ""]), rng.choice([text(), text(), text(), None, ""])) for _ in range(n)]


@pytest.mark.parametrize(("minimum", "reported"), [(4, 2000), (20, 15), (10_000, 5)])
def test_against_a_plain_count(spark, minimum, reported):
    rows = made(minimum, 300)
    docs = spark.createDataFrame([(k, t, lang, *"xxxxxx") for k, (lang, t) in enumerate(rows)], COLUMNS).repartition(3)
    got = collocations.collocations(docs, minimum=minimum, reported=reported)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, minimum, reported=reported)


def test_same_as_sql(spark, sf_dir, duck):
    same_rows(collocations.op13_collocations(spark, sf_dir), duck.execute(collocations.OP13_SQL))


def test_long_and_repeated_texts(spark):
    rows = [("en", "one two three " * 30_000), ("en", "w" * 3_000_000 + " tail"), ("de", "same same same"), ("de", "same same same"), ("de", "  \x00 \x0c\x0b")]
    docs = spark.createDataFrame([(1, t, lang, *"xxxxxx") for lang, t in rows], COLUMNS)
    assert sorted(tuple(r) for r in collocations.collocations(docs, minimum=2).collect()) == plain(rows, 2)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_blocks_of_a_text_join(monkeypatch, block):
    text = made(1, 40)[3][1] or "The new york. stock,,x  \t y\n\n" * 9
    words = collocations.Words()
    whole = [words.names[k] for k in words.encode("en", collocations.prepared(text))]
    assert [w for w in whole if w != b"\n"] == [w.encode() for piece in re.split(r"[.,;:!?\n-\r]", "".join(c.lower() if c.isascii() else c for c in text)) for w in re.findall(r"[^ \t]+", piece)]
    monkeypatch.setattr(collocations, "BLOCK", block)
    words = collocations.Words()
    assert [words.names[k] for k in words.encode("en", collocations.prepared(text))] == whole


def test_words_may_be_given_up(monkeypatch):
    import pyarrow as pa

    rng = random.Random(6)
    rows = [(rng.choice(["en", "de"]), " ".join(rng.choices("abcdefgh", k=30))) for _ in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows[k : k + 30]]), pa.array([t for _, t in rows[k : k + 30]])], ["lang", "text"]) for k in range(0, 200, 30)]
    want = Counter((lang, w) for lang, t in rows for w in t.split()) + Counter({(lang, None): 30 * n for lang, n in Counter(x for x, _ in rows).items()})
    for chunk, remembered in ((1, 3), (300, 5), (1 << 20, 10), (400, 100)):
        monkeypatch.setattr(collocations, "CHUNK", chunk)
        monkeypatch.setattr(collocations, "REMEMBERED", remembered)
        got = Counter()
        for out in collocations.counted_words(iter(batches)):
            for lang, phrase, a in zip(*(c.to_pylist() for c in out.columns), strict=True):
                got[lang, phrase] += a
        assert got == want


def test_windows_of_positions_join(monkeypatch):
    import pyarrow as pa

    text = " ".join(random.Random(5).choices(["a", "b", "c"], k=500))
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text, "a b c"])], ["lang", "text"])
    every = np.full(8, 255, np.uint8)
    for positions in (3, 64, 1 << 20):
        monkeypatch.setattr(collocations, "POSITIONS", positions)
        got = Counter()
        for out in collocations.counted_phrases(iter([batch]), 3, every, 58):
            for _, phrase, a in zip(*(c.to_pylist() for c in out.columns), strict=True):
                got[phrase] += a
        words = text.split()
        assert got == Counter(" ".join(words[i : i + 3]) for i in range(498)) + Counter(["a b c"])


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**13, 15 * 10**12, 10**13, 10**13), (7, 10**15, 7, 8)], "a bigint, n bigint, l bigint, r bigint")
    got = [r[0] for r in row.select(collocations._score(row["a"], row["n"], row["l"], row["r"])).collect()]
    assert got == [1000 * 10**13 * 15 * 10**12 // 10**26, 1000 * 7 * 10**15 // 56]

"""Every query against its plain version, on the smallest tables and on made ones."""

import random

import brute
import duckdb
import pandas as pd
import pytest
from conftest import same_rows

from tidemark.llm import bpe, decontamination, embeddings, queries, toxicity
from tidemark.session import table

WORDS = [f"{a}{b}{c}" for a in ("ba", "ce", "di", "fo", "gu") for b in ("la", "me", "ni", "ro") for c in ("sh", "th", "nd", "ck", "mp")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]


def write(path, **tables):
    for name, frame in tables.items():
        frame.to_parquet(f"{path}/{name}.parquet", index=False)
    return str(path)


def test_embeddings(spark, sf_dir, tmp_path):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        seed = random.Random(i % 60 if i % 3 else i)
        rows.append((i, [seed.gauss(0, 1) + rng.gauss(0, 0.2) for _ in range(16)]))
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, rows[0][1]), (305, [1.0, 2.0])]
    made = write(tmp_path, embeddings=pd.DataFrame(rows, columns=["vec_id", "embedding"]).assign(label=0))
    given = [(r["vec_id"], list(r["embedding"])) for r in table(spark, sf_dir, "embeddings").collect()]
    for path, data in ((made, rows), (sf_dir, given)):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.QUERIES["op1_embedding_graph"](spark, path).collect()}
        assert got == brute.embedding_links(data)


def test_embeddings_without_a_good_overlap(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        seed = random.Random(i % 40)
        rows.append((i, [seed.gauss(0, 1) + rng.gauss(0, 0.3) for _ in range(8)]))
    monkeypatch.setattr(embeddings, "MARGINS", ())
    monkeypatch.setattr(embeddings, "BLOCK", 90)
    made = write(tmp_path, embeddings=pd.DataFrame(rows, columns=["vec_id", "embedding"]).assign(label=0))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.QUERIES["op1_embedding_graph"](spark, made).collect()}
    assert got == brute.embedding_links(rows)


def test_urls(spark, sf_dir, duck, tmp_path):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/a?b#c", "http://a.example.com/en/", "http://example.com/en", "http://xexample.com/en/", "https://b.NET/es/x", "x://net/fr/?q", "a://b.com?x/y", "a://b.com/://net/es/", "x://www.example.com/en/", "x://com/"]
    made = write(tmp_path, pages=pd.DataFrame({"page_id": range(len(urls)), "url": urls, "html": ""}))
    got = {r["page_id"]: tuple(r)[1:] for r in queries.QUERIES["op2_url_filter"](spark, made).collect()}
    assert got == {k: brute.judged_url(u) for k, u in enumerate(urls)}
    same_rows(queries.QUERIES["op2_url_filter"](spark, sf_dir), duck.execute(queries.SQL["op2_url_filter"]))
    other = duckdb.connect()
    other.execute(f"CREATE VIEW pages AS SELECT * FROM '{made}/pages.parquet'")
    same_rows(queries.QUERIES["op2_url_filter"](spark, made), other.execute(queries.SQL["op2_url_filter"]))


def test_bpe(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.tokenizer_file())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    rows = [*docs, (-1, None), (-2, ""), (-3, "a<|endoftext|>b 日本語 🙂 \u3000\u00a0 x's"), (-4, "ab" * 30_000), (-5, " \n\n  ١٢ ǅ é e\u0301")]
    made = write(tmp_path, documents=pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = {}
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(tokenizer.decode(ids, skip_special_tokens=False)))
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op3_bpe"](spark, made).collect()} == want


def test_line_templates(spark, docs, sf_dir):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op4_line_templates"](spark, sf_dir).collect()}
    assert got == {i: (n, gone, brute.sha(left)) for i, (n, gone, left) in brute.recurring_lines(docs).items()}


def test_decontamination(spark, tmp_path):
    rng = random.Random(3)
    items = [(k, prose(rng, 12 + k)) for k in range(6)] + [(90, None), (91, "short"), (6, "the secret answer 42"), (7, "nine four")]
    rows = []
    for k in range(60):
        text, item = prose(rng, 40), items[k % 6][1]
        if k % 2:
            at = rng.randrange(len(item))
            passage = list(item.upper() if k % 4 == 1 else item)
            for _ in range(k // 8):
                passage[rng.randrange(len(passage))] = rng.choice("xyzq")
            text = f"{text[:100]} {''.join(passage)} {text[100:]}" if k % 5 else "".join(passage) + item[at:at]
        rows.append((k, text))
    rows += [(100, None), (101, ""), (102, "what is THE sekret answer 42 then"), (103, "the secret answer"), (104, "and nine\tfour"), (105, "nine for")]
    made = write(tmp_path, documents=pd.DataFrame(rows, columns=["doc_id", "text"]), benchmark=pd.DataFrame(items, columns=["item_id", "text"]))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in queries.QUERIES["op5_decontamination"](spark, made).collect()}
    want = {}
    for i, t in rows:
        for item, p in [x for x in items if x[0] < 90]:
            distance = brute.nearest_part(p, decontamination.folded(t or ""))
            if distance <= int(len(p) * decontamination.DISTANCE):
                want[i, item] = distance
    assert set(got) <= set(want)
    assert len(got) >= 0.99 * len(want) > 20
    assert all(got[k] == want[k] for k in got)


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op6_toxicity"](spark, sf_dir).filter("held_out").join(table(spark, sf_dir, "labels"), "doc_id").select("score", "predicted", "toxic").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert 2 * hit / (sum(r["predicted"] for r in rows) + sum(r["toxic"] for r in rows)) >= 0.8


def test_misspelt_terms():
    automaton = toxicity.TermAutomaton(["vermin", "scoundrels", "oaf", "trash*"])
    assert automaton.find("vermin") == (0, 0) and automaton.find("vermn") == (0, 1) and automaton.find("scuondrels") == (1, 2)
    assert automaton.find("oat") is None and automaton.find("trashy") == (3, 0) and automaton.find("house") is None


def test_automaton_against_plain_edit_distance():
    rng = random.Random(4)
    terms = ["".join(rng.choice("abcd") for _ in range(rng.randrange(3, 14))) for _ in range(40)]
    automaton = toxicity.TermAutomaton(terms)
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word))
            word[at : at + rng.randrange(2)] = rng.choice(["", "a", "bc", "d"])
            word = word or ["a"]
        word = "".join(word)
        near = [(d, k) for k, t in enumerate(terms) if (d := brute.edit_distance(word, t)) <= toxicity.tolerance(t)]
        found = automaton.find(word)
        assert (found is None) == (not near) and (found is None or found == (min(near)[1], min(near)[0])), word


@pytest.mark.parametrize(
    ("text", "share"),
    [
        ('he said "scum" to her', 1.0), ('he said "you scum" to her', 1.0), ('the "scum of the earth" line', 0.6), ("the «scum» line", 0.6), ("the « scum » line", 0.6), ("das „scum“ da", 0.6),
        ("you scum", 0.0), ('"hello," you scum', 0.0), ("don't be scum, don't", 0.0), ('he said you scum', 0.4), ('"one" scum "two"', 0.0), ("(\"scum\")", 0.6), ('scum', 0.0), ('"scum', 0.0),
        ('"a b c d e f g scum" here', 0.0),
    ],
)
def test_quotation(text, share):
    words = list(toxicity.WORD.finditer(text))
    assert toxicity.quoted_share(text, words, [w.group() for w in words].index("scum")) == share


def test_personal_data(spark, docs, tmp_path):
    rows = [*docs, (-1, None), (-2, ""), (-3, "a@b a@b.c..d x@y.z@w.v 1.2.3.4.5 1.2.3.456 256.1.1.1.1 4111 1111-1111 1111 and +49 (0) 123-4567 +1 2"), (-4, "1" * 50_000), (-5, "é🙂 me@x.org\u0660 10.0.0.255 +" + "1" * 15), (-6, "x" * 50_000 + "@a.b"), (-7, "0004111111111111111 +1+123456789 00001.1.1.01")]
    made = write(tmp_path, documents=pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_personal_data"](spark, made).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        found = brute.base_spans(t)
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(f[0] == k for f in found) for k in ("email", "ip", "card", "phone")], i
        listed = [":".join(map(str, f)) for f in found]
        assert got[i]["base_sha256"] == brute.sha(",".join(listed)), i
        assert set(listed) <= set(got[i]["spans"].split(",")), i


def test_repeated_bytes(spark, docs, tmp_path):
    rng = random.Random(8)
    passage = prose(rng, 90)
    rows = [*docs, (-1, None), (-2, ""), (-3, "ab" * 700), (-4, passage + prose(rng, 50)), (-5, prose(rng, 50) + passage), (-6, passage[:400]), (-7, passage[1:400]), (-8, "é" * 300)]
    made = write(tmp_path, documents=pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op8_suffix_dedup"](spark, made).collect()}
    assert got == dict(zip([i for i, _ in rows], brute.without_repeats([t for _, t in rows])))


def test_minhash(spark, docs, tmp_path):
    rng = random.Random(9)
    rows = [*docs, (-1, None), (-2, ""), (-3, " \n"), (-4, "one two"), (-5, "ONE two"), (-6, "one two three")]
    for k in range(30):
        words = prose(rng, 120).split()
        rows.append((10_000 + 3 * k, " ".join(words)))
        words[rng.randrange(120)] = "changed"
        rows.append((10_001 + 3 * k, " ".join(words)))
        words[rng.randrange(120)] = "again"
        rows.append((10_002 + 3 * k, " ".join(words).upper()))
    made = write(tmp_path, documents=pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op9_minhash_forest"](spark, made).collect()}
    assert got == brute.near_duplicates(rows)


def test_paragraphs(spark, tmp_path):
    rng = random.Random(10)
    passage = [prose(rng, 60) for _ in range(5)]
    rows = [(k, f"{prose(rng, 200)} {passage[k % 5] if k % 2 else prose(rng, 60)} {prose(rng, 100)}") for k in range(40)]
    near = prose(rng, 80).split()
    rows += [(50, "x\n" + " ".join(near)), (51, "y y\n" + " ".join([*near[:40], "other", *near[41:]])), (52, None), (53, "")]
    made = write(tmp_path, documents=pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_paragraphs"](spark, made).collect()}
    assert set(got) == {k for k in range(40) if k % 2} | {50, 51}
    first = {min(k for k in range(1, 40, 2) if k % 5 == p) for p in range(5)} | {50}
    for k, r in got.items():
        assert (r["n_removed"] == 0) == (k in first), k
        if k < 40 and k not in first:
            places = [tuple(map(int, p.split(":"))) for p in r["removed"].split(",")]
            assert all(200 <= a < b <= 260 for a, b in places) and r["n_removed"] >= 19
    line = [tuple(map(int, p.split(":"))) for p in got[51]["removed"].split(",")]
    assert line == [(2, 82)]

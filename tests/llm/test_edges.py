"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import brute
import pytest

from tidemark.llm import bpe, decontamination, embeddings, line_templates, minhash, paragraphs, pii, queries, suffixes, toxicity, urls

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = "doc_id bigint, text string, score string, predicted string, token_ids string, decoded string, row string, signature string, n string, pos string, key string, email string, added string, component string, kept string, id string, t string"
LONG = "one two three four five six seven " * 20_000
TEXTS = [(1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (2, None), (None, "a null id with words in it"), (None, None), (3, ""), (4, LONG), (5, LONG), (6, "alpha beta gamma delta epsilon zeta"), (7, "\n\n \t\n")]


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with what may be odd, and columns named like those that the operators make."""
    return spark.createDataFrame([(i, t, *[None if k % 2 else "x"] * 15) for k, (i, t) in enumerate(TEXTS)], CLASH)


def test_empty_tables(spark, tmp_path):
    made = {"documents": DOCS, "embeddings": "vec_id bigint, embedding array<float>, label int", "pages": "page_id bigint, url string, html string", "benchmark": "item_id bigint, text string", "labels": "doc_id bigint, quality int, toxic int"}
    for name, schema in made.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).collect() == [], name


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [0.0, -0.0])]
    out = embeddings.near_duplicates(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id bigint, embedding array<float>, v string, id int, copies int")).collect()
    got = sorted((tuple(r)[:3] for r in out), key=str)
    assert len(out) == len(rows)
    assert [x for x in got if x[0] in (1, 2)] == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert all(x[1:] == (0, x[0]) for x in got if x[0] not in (1, 2))


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "x"), (1, "http://a.com/", None), (None, None, None)], "page_id bigint, url string, host string")
    assert sorted(r["rule"] or "" for r in urls.filter_urls(pages).collect()) == ["", "com/", "com/"]
    assert {r["verdict"] for r in urls.filter_urls(pages, rules=()).collect()} == {"allow"}


def test_urls_with_clashing_columns_and_a_split_list(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.com/x", "h", "p", "r", "v", "k", "f")], "page_id bigint, url string, host string, path string, rule string, verdict string, keys string, _found string")
    row = urls.filter_urls(pages).first().asDict()
    assert row == {"page_id": 1, "url": "http://a.com/x", "host": "a.com", "path": "/x", "rule": "com/", "verdict": "allow", "keys": "k", "_found": "f"}
    monkeypatch.setattr(urls, "MAX_LEVEL_BITS", 64)
    rules = [urls.Rule(f"h{k}.org", "/", "block" if k % 3 else "allow") for k in range(120)]
    asked = spark.createDataFrame([(k, f"http://x.h{k}.org/") for k in range(150)], "page_id bigint, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(asked, rules).collect()}
    assert got == {k: (f"h{k}.org/", "block" if k % 3 else "allow") if k < 120 else (None, "allow") for k in range(150)}


def test_bpe(docs):
    out = bpe.encode_documents(docs, bpe.tokenizer_file(), decoded="decoded").collect()
    assert sorted(r["decoded"] for r in out) == sorted(t or "" for _, t in TEXTS)
    assert bpe.decode_documents(bpe.encode_documents(docs, bpe.tokenizer_file()).drop("text"), bpe.tokenizer_file(), text="text").filter("text is null").count() == 0


def test_line_templates(spark, docs):
    assert sorted(r["text"] or "" for r in line_templates.drop_recurring_lines(docs).collect()) == sorted(t or "" for _, t in TEXTS)
    rows = [(k, f"Page {k} of the user manual\nown words {chr(97 + k)}") for k in range(12)]
    out = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[0] == rows[0][1] and all(out[k] == f"own words {chr(97 + k)}" for k in range(1, 12))


def test_line_templates_with_clashing_columns(spark):
    shared = " ".join(f"w{chr(97 + k % 26)}" for k in range(450))
    rows = [(k, f"{shared} {k} end\nown {chr(97 + k)}", 9, "a", "b", "c", "d", "e") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, id string, places string, `left` string, dropped string, tokens string")
    out = {r["doc_id"]: tuple(r)[1:] for r in line_templates.drop_recurring_lines(docs).collect()}
    assert out[0] == rows[0][1:] and all(out[k] == (f"own {chr(97 + k)}", 5, "a", "b", "c", "d", "e") for k in range(1, 12))


def test_decontamination(spark, docs):
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta", 1), (2, None, 1), (None, LONG, 1), (3, "", 1), (4, "alpha beta gamma delta epsilon zeta", 1)], "item_id bigint, text string, doc_id int")
    assert sorted(tuple(r)[:2] for r in decontamination.find_leaks(docs, benchmark).collect()) == [(1, 1), (1, 1), (1, 4), (1, 4), (6, 1), (6, 4)]
    left = decontamination.drop_leaks(docs, benchmark)
    assert left.columns == docs.columns and left.count() == 7


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, None, None), (None, 1, 1), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    assert out.count() == len(TEXTS) and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert out.filter("text is null or text = ''").select("score").distinct().count() == 1
    none = toxicity.score(docs, toxicity.fit(docs, labels.limit(0)))
    assert none.filter("predicted = 1").count() == 0


def test_personal_data(docs):
    out = pii.find_personal_data(docs)
    assert out.columns == [*docs.columns, "personal"] and out.filter("size(personal) > 0").count() == 0
    assert out.filter("email = 'x'").count() == docs.filter("email = 'x'").count() > 0


def test_repeated_bytes(docs):
    out = suffixes.remove_repeated(docs).collect()
    assert len(out) == len(TEXTS)
    assert sorted((r["doc_id"], r["n_removed"]) for r in out if r["n_removed"]) == [(4, len(LONG)), (5, len(LONG))]


def test_crowded_gram(spark):
    texts = [f"{k:05d} " * 60 + "shared passage of words " * 20 + f"{k * 7:05d} " * 60 for k in range(12)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute.without_repeats(texts)
    for group in (1, 5, 1000):
        known, spans = suffixes.repeated_spans(rows, row="doc_id", group=group)
        found = {r["row"]: r["spans"] for r in spans.collect()}
        got = [suffixes.remove_spans(t.encode(), found.get(k, [])) for k, t in enumerate(texts)]
        assert [(len(t), g[0], g[1], brute.sha(g[2])) for t, g in zip(texts, got)] == want


def test_minhash(docs):
    out = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in minhash.near_duplicates(docs).collect())
    assert [x for x in out if x[0] in (1, 6)] == [(1, 2, 1), (1, 2, 1), (6, 2, 1)]
    assert [x[2] for x in out if x[0] in (4, 5)] == [4, 4] and [x for x in out if x[0] == 3] == [(3, 0, 3)]
    assert len(out) == len(TEXTS)


def test_paragraphs(docs):
    found = paragraphs.merged_runs(paragraphs.repeated_paragraphs(docs).filter("NOT kept"))
    assert {r["doc_id"] for r in found.collect()} == {5}

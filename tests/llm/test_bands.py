"""Bands that lines share without being near each other."""

import random

import brute
from test_groups import star

from tidemark.llm import paragraphs


def test_lines_that_share_a_phrase(spark):
    rng = random.Random(12)

    def words(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]

    phrase, texts = words(60), []
    for k in range(1200):
        line = phrase + words(40)
        texts.append(" ".join(line))
        if k % 3 == 0:
            line[rng.randrange(70, 90)] = "changed"
            texts.append(" ".join(line))
    rows = [*enumerate(texts), *star(rng, 300, 10_000)]
    want = {}
    for i, (_, c) in brute.near_duplicates(rows).items():
        want.setdefault(c, set()).add(i)
    want = {frozenset(g) for g in want.values() if len(g) > 1}
    found = paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id bigint, text string"))
    length, got = {i: len(t.split()) for i, t in rows}, {}
    for r in found.collect():
        if (r["start"], r["stop"]) == (0, length[r["doc_id"]]):
            got.setdefault(r["component_id"], set()).add(r["doc_id"])
    assert len(want) == 401
    assert {frozenset(g) for g in got.values()} == want


def test_passages_over_short_lines(spark):
    """Passages of 56 words in 14 lines of four, each in two documents of other words."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    lines = lambda n: "\n".join(" ".join(word() for _ in range(4)) for _ in range(n))
    rows, places = [], {}
    for k in range(40):
        passage = lines(14)
        for doc in (2 * k, 2 * k + 1):
            before = rng.randint(10, 30)
            rows.append((doc, f"{lines(before)}\n{passage}\n{lines(rng.randint(10, 30))}"))
            places[doc] = (4 * before, 4 * before + 56)
    found = paragraphs.merged_runs(paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))).collect()
    got = {r["doc_id"]: (r["start"], r["stop"]) for r in found}
    assert len(got) >= 0.95 * len(rows) and len(found) == len(got)
    assert all(places[d][0] - 1 <= a and b <= places[d][1] + 1 for d, (a, b) in got.items())


def test_what_line_components_leave(spark):
    """Only plausible pairs are confirmed on their sets, and tables that are used up go."""
    import glob

    from tidemark.session import ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(glob.glob(f"{folder}/table-*"))
    rng = random.Random(14)
    rows = [(k, " ".join(f"w{rng.randrange(10**9)}" for _ in range(40))) for k in range(60)]
    rows += [(100 + k, t + " more") for k, t in rows[:20]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lines = paragraphs.cut(paragraphs.units(docs)).filter("signature IS NOT NULL")
    got = {}
    for r in paragraphs.line_components(lines, docs).collect():
        got.setdefault(r["component"], set()).add(r["id"])
    assert len(got) == 20 and all(len(g) == 2 for g in got.values())
    left = [spark.read.parquet(t).columns for t in set(glob.glob(f"{folder}/table-*")) - before]
    assert not [c for c in left if c in (["id", "shingles"], ["id", "signature"], ["band", "id", "tree", "a"])]
    wanted = spark.createDataFrame([(1, 2, [1] * 18, [1] * 6 + [2] * 12), (1, 3, [1] * 18, [1] * 5 + [2] * 13)], "a bigint, b bigint, s array<int>, t array<int>")
    assert [r["b"] for r in wanted.mapInArrow(paragraphs._plausible_pairs, "a bigint, b bigint").collect()] == [2]

"""Groups in which only some pairs are near, however crowded they are."""

import random

import brute
import pytest

from tidemark.llm import minhash


def star(rng, size, first, words=204, changed=5):
    """An original and copies of it that are near the original only, with shuffled ids."""
    original = [f"w{rng.randrange(10**9)}" for _ in range(words)]
    texts = [" ".join(original)]
    for k in range(size):
        copy = list(original)
        for at in rng.sample(range(5, words - 5, 10), changed):
            copy[at] = f"x{k}y{at}"
        texts.append(" ".join(copy))
    ids = list(range(first, first + len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize("sizes", [(50, 200), (3000,)])
def test_minhash_star(spark, sizes):
    rng = random.Random(11)
    groups = [star(rng, size, 10_000 * k) for k, size in enumerate(sizes)]
    rows = [r for g in groups for r in g] + [(90_000 + k, " ".join(f"z{rng.randrange(10**9)}" for _ in range(60))) for k in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    if max(sizes) <= 200:
        want = {i: c for i, (_, c) in brute.near_duplicates(rows).items()}
    else:
        whole = {i: brute.shingles(t) for i, t in rows}
        links = []
        for group in groups:
            centre = group[0][0]
            links += [(centre, i) for i, _ in group[1:] if 100 * len(whole[centre] & whole[i]) >= 75 * len(whole[centre] | whole[i])]
        want = brute.components(whole, links)
    # An LSH forest misses a pair with probability 1.5e-4.
    assert sum(got[i] != want[i] for i in want) <= max(sizes) // 1000

"""Near-deduplication against brute force."""

import random
import re

import numpy as np
import pytest

from fieldhouse.llm import near_dup
from fieldhouse.llm.components import components

DOCS = "doc_id long, text string, k long, n int, component_id long"


def brute(docs, width):
    sets = {}
    for i, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        size = min(width, len(words))
        sets[i] = {tuple(words[j : j + size]) for j in range(len(words) - size + 1)} if words else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = list(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                ra, rb = sorted((root(a), root(b)), key=lambda x: -1 if x is None else x)
                parent[rb] = ra
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def corpus(seed, n):
    pick = random.Random(seed)
    vocabulary = ["The", "of", "a"] * 4 + [f"w{i}" for i in range(400)]
    fresh = lambda: [pick.choice(vocabulary) for _ in range(pick.randrange(1, 120))]
    docs, base = [], [fresh() for _ in range(12)]
    for i in range(n):
        words = list(pick.choice(base)) if pick.random() < 0.6 else fresh()
        for _ in range(pick.choice([0, 0, 1, 2, 4, 8])):
            words[pick.randrange(len(words))] = pick.choice(vocabulary)
        docs.append((i * 2, pick.choice([" ", "\n"]).join(words)))
    chain = fresh() + fresh() + fresh()
    for i in range(60):  # a chain: neighbours are alike, its ends are not
        docs.append((5000 - i, " ".join(chain)))
        chain = chain[3:] + [f"c{i}a", f"c{i}b", f"c{i}c"]
    odd = [None, "", " \n", "one", "ONE", "two words", "Two  Words", "é É", "x " * 30000]
    return docs + [(9000 + i, t) for i, t in enumerate(odd)]


@pytest.mark.parametrize("options", [{}, {"small": 3, "deepest": 3}, {"small": 8, "sparse": 0, "deepest": 2}, {"small": 100, "sparse": 0}])
def test_op5_equals_brute_force(spark, options):
    docs = corpus(len(options), 250)
    df = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in docs], DOCS).repartition(3)
    rows = near_dup.linked(df, width=2, **options).collect()
    got = {r["k"]: (r["n_shingles"], r["component_id"], r["k"] == r["component_id"]) for r in rows}
    assert got == brute(docs, 2) and len(rows) == len(docs)


def loose_group(seed, n):
    """A group whose members differ from one text in 1 to 14 words of 75: many pairs on both sides of the threshold."""
    pick = random.Random(seed)
    base = [f"b{i}" for i in range(75)]
    docs = []
    for i in range(n):
        words = list(base)
        for at in pick.sample(range(75), pick.randrange(1, 15)):
            words[at] = pick.choice(["x", "y", f"n{i}"]) + str(at % 9)
        docs.append((i * 3 + 1, " ".join(words)))
    return docs


@pytest.mark.parametrize("options", [{}, {"small": 60, "sparse": 1, "deepest": 2}])
def test_op5_large_loose_group(spark, options):
    docs = loose_group(4, 400)
    df = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in docs], DOCS).repartition(3)
    got = {r["k"]: (r["n_shingles"], r["component_id"], r["k"] == r["component_id"]) for r in near_dup.linked(df, width=2, **options).collect()}
    want = brute(docs, 2)
    assert got == want and len({v[1] for v in want.values()}) > 20


def test_overlaps_of_sets():
    draw = np.random.default_rng(5)
    left, right = ([np.unique(draw.integers(0, 3000, draw.integers(1, 900)).astype(np.uint64)) for _ in range(n)] for n in (7, 5))
    assert near_dup.overlaps(left, right).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]


def test_op5_contract_and_stage(spark):
    docs = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (7, "q r"), (8, None), (None, "q r"), (9, "z z")]
    df = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in docs], DOCS)
    rows = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.contract(df).collect()), key=str)
    assert rows == sorted([(3, 5, 1, False), (1, 5, 1, True), (1, 5, 1, True), (7, 1, None, False), (8, 0, 8, True), (None, 1, None, True), (9, 1, 9, True)], key=str)
    kept = near_dup.deduplicated(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "8", "9", "None"]
    assert near_dup.contract(df.filter("false")).count() == 0


@pytest.mark.parametrize("block", [100_000, 20])
def test_components_of_chains_and_stars(spark, block):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(300, 200), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), block=block).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {200: 200, 300: 200}

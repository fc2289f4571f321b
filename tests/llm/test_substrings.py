"""Repeated substrings against brute force."""

import random
from hashlib import sha256

import numpy as np
import pytest

from fieldhouse.llm import substring_dedup
from fieldhouse.llm.substrings import BlockSuffixes, Segmenter, repeated_starts

DOCS = "doc_id long, text string, c0 string, k int, n_chars long"


def brute(docs, length):
    """docs: id -> text. Places are judged in order of id, then start."""
    seen, out = set(), {}
    for i in sorted(docs, key=lambda x: -1 if x is None else x):
        data = (docs[i] or "").encode()
        gone = np.zeros(len(data), bool)
        for a in range(len(data) - length + 1):
            if data[a : a + length] in seen:
                gone[a : a + length] = True
            seen.add(data[a : a + length])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(data), int(gone.sum()), spans, sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest())
    return out


def corpus(seed, n=60):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdé ") for _ in range(pick.randrange(1, 9)))
    passage = ["".join(word() for _ in range(pick.randrange(20, 60))) for _ in range(6)]
    docs = {}
    for i in range(n):
        parts = []
        for _ in range(pick.randrange(5)):
            p = pick.choice(passage)
            a = pick.randrange(len(p))
            parts += [pick.choice([p, p[a:], p[:a]]), "".join(word() for _ in range(pick.randrange(12)))]
        docs[i * 3] = "".join(parts)
    docs |= {1: None, 2: "", 4: "a" * 700, 5: "ab" * 300, 7: docs[3], 8: docs[3], 10: "-" * 99, 11: "-" * 400, 13: docs[0] + docs[6]}
    return docs


def test_suffix_blocks_equal_brute_force(monkeypatch):
    from fieldhouse.llm import substrings

    monkeypatch.setattr(substrings, "BUCKET", 500)
    pick = random.Random(8)
    for alphabet in ("ab", "abcdefgh"):
        text = "".join(pick.choice(alphabet) for _ in range(3000)).encode()
        text = text + text[200:900] + text[100:1000] + b"x" + text[2000:2500] + b"a" * 300
        at = np.arange(len(text) - 100 + 1)
        suffixes = BlockSuffixes(text)
        order = np.concatenate([suffixes.sorted_bucket(b)[0] for b in suffixes.buckets(at)])
        strings = [text[i : i + 100] for i in order.tolist()]
        assert strings == sorted(strings) and len(strings) == len(at)
        doc, place = at // 700, at % 700
        first = {}
        for i in at.tolist():
            first.setdefault(text[i : i + 100], i)
        want = [first[text[i : i + 100]] != i for i in at.tolist()]
        assert repeated_starts(text, at, doc, place).tolist() == want


def test_runs_cover_each_string_once():
    docs = [(t or "").encode() for t in corpus(3).values()]
    doc, start, count, h, s = Segmenter(40, 16)(docs)
    got = sorted((d, a + j) for d, a, c in zip(doc.tolist(), start.tolist(), count.tolist()) for j in range(c))
    assert got == sorted((d, a) for d, t in enumerate(docs) for a in range(len(t) - 40 + 1))
    anchors = {}
    for d, a, c, key in zip(doc.tolist(), start.tolist(), count.tolist(), h.tolist()):
        for j in range(c):
            assert anchors.setdefault(docs[d][a + j : a + j + 40], key) == key


@pytest.mark.parametrize("most_runs,block_bytes", [(5000, 1_500_000), (1, 2000), (4, 300)])
def test_op6_equals_brute_force(spark, most_runs, block_bytes):
    docs = corpus(most_runs)
    rows = [(i, t, "x", 1, 0 if t is None else len(t)) for i, t in docs.items()]
    df = spark.createDataFrame(rows, DOCS).repartition(5, "doc_id")
    want = brute(docs, 100)
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.contract(df, most_runs=most_runs, block_bytes=block_bytes).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 3000
    if most_runs == 4:
        out = substring_dedup.deduplicated(df, most_runs=most_runs, block_bytes=block_bytes)
        assert out.columns == df.columns
        for r in out.collect():
            assert r["k"] == 1 and r["c0"] == "x" and (r["text"] is None) == (docs[r["doc_id"]] is None)
            if want[r["doc_id"]][1] == 0:
                assert r["text"] == docs[r["doc_id"]]
            else:
                assert len(r["text"].encode()) <= want[r["doc_id"]][0] - want[r["doc_id"]][1] and r["n_chars"] == len(r["text"])


def test_op6_odd_rows(spark):
    pick = random.Random(1)
    text = "".join(pick.choice("abcdef ") for _ in range(400))
    df = spark.createDataFrame([(1, text, "", 0, 0), (1, text, "", 0, 0), (None, text[:150], "", 0, 0), (9, text, "", 0, 0)], DOCS)
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring_dedup.contract(df).collect())
    assert got == [(-1, 0), (1, 150), (1, 150), (9, 400)]
    assert substring_dedup.contract(df.filter("false")).count() == 0


def test_op6_ids_of_several_texts(spark):
    """An id with two texts: each is a document of its own, and a text that occurs once loses nothing."""
    pick = random.Random(2)
    a, b, c = ("".join(pick.choice("abcdef ") for _ in range(419)) for _ in range(3))
    df = spark.createDataFrame([(1, b, "x", 0, 0), (5, a, "y", 0, 0), (5, b, "z", 0, 0), (None, c, "u", 0, 0), (None, a, "v", 0, 0)], DOCS)
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in substring_dedup.contract(df).collect())
    assert got == [(0, 419, 0), (0, 419, 0), (1, 419, 0), (5, 419, 419), (5, 419, 419)]
    out = {r["c0"]: r["text"] for r in substring_dedup.deduplicated(df).collect()}
    assert out == {"x": b, "y": "", "z": "", "u": c, "v": a}

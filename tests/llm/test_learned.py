"""Quality statistics and language identification against brute force and held-out accuracy."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fieldhouse.llm import language_id, quality

DOCS = "doc_id long, text string, lang string, source string, n_words int, kept string"


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(hit)


def some_texts(seed=1):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdé日") for _ in range(pick.randrange(1, 7)))
    out = [None, "", "\n\n", "a b c\na b c\r\n a b c\n", "\x1c\x85\xa0 x\x0b\x0cy", "# * $ % & | < >", "one two three four five six seven eight " * 3, "x " * 40000]
    for _ in range(150):
        base = [word() for _ in range(pick.randrange(5, 200))]
        out.append(pick.choice([" ", "\n"]).join(base + base[: pick.choice([0, 0, 7, 8, 30])]))
    return out


def test_op4_statistics_and_verdicts(spark):
    texts = some_texts()
    texts += texts[:20]
    rows = [(i, t, [None, "en", "fr"][i % 3] if i % 50 else "rare", "s", 0, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    for r in quality.contract(docs).collect():
        want = counted(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality.COUNTS) == want, r
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])
    kept = quality.kept(docs)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.contract(docs).filter("kept").collect()}
    assert quality.contract(docs.filter("false")).count() == 0 == quality.kept(docs.filter("false")).count()


def test_op4_rejects_planted_outliers_and_keeps_clean(spark):
    pick = random.Random(4)
    clean = [" ".join("".join(pick.choice("abcdefgh") for _ in range(pick.randrange(2, 9))) for _ in range(pick.randrange(40, 900))) for _ in range(400)]
    junk = [" | ".join("".join(pick.choice("abcdefgh") for _ in range(pick.randrange(5, 12))) for _ in range(60)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s" if i % 2 else "hot", 0, "") for i, t in enumerate(clean + junk)], DOCS)
    kept = {r["doc_id"] for r in quality.contract(docs).filter("kept").collect()}
    assert kept == set(range(400))


def test_op4_finds_the_least_determinant(spark):
    """The estimates against a search of all subsets of small groups; the shape of each group's cloud is different."""
    from itertools import combinations

    draw = np.random.default_rng(12)
    rows = []
    for g in range(4):
        for i in range(16):
            n = int(np.exp(draw.normal(5.5, 0.5 + 0.2 * g))) + 20
            far = i >= 12
            rows.append((g * 100 + i, "en", f"s{g}", n, int(n * np.exp(draw.normal(1.5 + far * 0.9, 0.1 + 0.1 * g))), int(n * draw.uniform(0, 0.1 + 0.6 * far)), int(n * draw.uniform(0, 0.2)), int(n * draw.uniform(0, 0.28))))
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    found = {r["grp"]: r["det"] for r in quality.estimates(stats, min_rows=10).collect()}
    points = {r["source"]: [] for r in stats.collect()}
    for r in stats.select("source", F.array(*quality.vector()).alias("x")).collect():
        points[r["source"]].append(r["x"])
    assert len(found) == 4
    for source, x in points.items():
        x = np.array(x)
        least = min(np.linalg.det(np.cov(x[list(own)].T, bias=True)) for own in combinations(range(16), 12))
        assert least * (1 - 1e-6) <= found["en\x1f" + source] <= 2 * least, source


def test_op4_small_groups_take_their_language(spark):
    rows = [(i, lang, f"s{i % 9}", 100 + i % 7, 500 + i % 31, i % 3, i % 2, i % 5) for lang, count in (("en", 90), ("fr", 5), ("de", 60)) for i in range(count)]
    stats = spark.createDataFrame(rows + [(500 + i, "en", "big", 90 + i % 11, 480 + i, i % 4, 0, 0) for i in range(50)], "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    got = {r["own"]: r["grp"] for r in quality.estimates(stats, min_rows=40).filter("det is not null").collect()}
    assert got["en\x1fbig"] == "en\x1fbig" and got["en\x1fs3"] == "\x1elang\x1fen" and got["de\x1fs1"] == "\x1elang\x1fde" and got["fr\x1fs0"] == "\x1eall"


def test_op9_held_out_accuracy(spark):
    pick = random.Random(2)
    parts = {"aa": ["the", "ing", "wh", "ou"], "bb": ["sch", "ung", "ei", "ü"], "cc": ["eau", "oi", "é", "qu"]}
    text = lambda k: " ".join("".join(pick.choice(parts[k]) for _ in range(pick.randrange(1, 4))) for _ in range(pick.randrange(3, 40)))
    rows = []
    for i in range(400):
        k = pick.choice(list(parts))
        rows.append((i, text(k), k, "s", 0, "x"))
    odd = [(1000, None, "aa", "s", 0, "x"), (1001, "", None, "s", 0, "x"), (1002, "123 !?_ ½ ² ②", "bb", "s", 0, "x"), (1003, "sch " * 30000, None, "s", 0, "x"), (None, "eau oi", None, None, 0, "x")]
    docs = spark.createDataFrame(rows + odd, DOCS)
    out = language_id.contract(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert 50 < len(held) < 150
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.95 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "bb" and got[None]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language_id.contract(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert language_id.contract(docs.filter("false")).count() == 0


def test_op9_learns_rare_languages(spark):
    pick = random.Random(7)
    rows = [(i, " ".join(pick.choice(["the", "and", "ing"]) for _ in range(12)), "aa") for i in range(3000)] + [(5000 + i, " ".join(pick.choice(["zhu", "qx", "vw"]) for _ in range(12)), "zz") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, most_rows=200, least_rows=30)
    assert model.languages == ["aa", "zz"]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model).collect()}
    assert sum(got[r[0]] == r[2] for r in rows) > 0.99 * len(rows) and sum(got[5000 + i] == "zz" for i in range(30)) >= 29


def test_op9_learns_every_language(spark):
    """More languages than any list of frequent ones would hold: each is learned from its own letters."""
    import random

    pick = random.Random(5)
    words = {f"l{k:03d}": ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(6)] for k in range(230)}
    rows = [(i * 4 + 1, " ".join(pick.choices(own, k=12)), lang) for i, (lang, own) in enumerate((a, b) for a, b in words.items() for _ in range(3))]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_rows=700, least_rows=2)
    assert sorted(model.languages) == sorted(words)

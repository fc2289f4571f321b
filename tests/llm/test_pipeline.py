"""The pipeline's stages against brute force, one after another, on odd and ordinary rows."""

import random
from hashlib import sha256

import numpy as np
import pytest
from test_near_dup import brute as near_groups
from test_text_scans import brute_contamination, library

import corpus_pipeline
from fieldhouse.llm import quality
from fieldhouse.llm.queries import QUERIES, model_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, k long"


def rows(seed=6):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefghiklmnoprstu") for _ in range(pick.randrange(2, 9)))
    clean = lambda n: " ".join(word() for _ in range(n))
    passage, item = clean(60), clean(14)
    docs = [clean(pick.randrange(40, 200)) for _ in range(150)]
    docs += [docs[3], docs[3] + " more", docs[4].replace(" ", "  "), clean(30) + " " + passage + " " + clean(30), clean(25) + " " + passage, clean(30) + " " + item + " " + clean(30), " | ".join(clean(1) for _ in range(90)), "same words again and again and again here " * 20]
    docs += [None, "", "tiny", "é" * 50]
    return [(i * 2, t, "en", "s", len(t or ""), True, 7) for i, t in enumerate(docs)] + [(None, docs[5], None, None, None, None, None)], [(1, item), (2, None), (3, clean(5))]


def cut(texts):
    """Texts without bytes that 100-byte strings starting earlier cover; parts of characters go."""
    seen, out = set(), {}
    for i in sorted(texts, key=lambda x: -1 if x is None else x):
        data = texts[i].encode()
        gone = np.zeros(len(data), bool)
        for a in range(len(data) - 99):
            if data[a : a + 100] in seen:
                gone[a : a + 100] = True
            seen.add(data[a : a + 100])
        out[i] = bytes(np.frombuffer(data, np.uint8)[~gone]).decode(errors="ignore")
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    data, items = rows()
    sf = str(tmp_path)
    spark.createDataFrame(data, DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judged = {r["doc_id"]: r["kept"] for r in quality.contract(docs).collect()}
    left = {r[0]: r[1] for r in data if judged[r[0]]}
    assert len(left) >= 150 and 2 * 156 not in left and 2 * 157 not in left
    want = [left]
    groups = near_groups(list(left.items()), 5)
    # the brute force takes its groups' first listed id; the stage keeps the smallest id, and a null id is the smallest
    members = {}
    for i, (_, root, _) in groups.items():
        members.setdefault(root, []).append(i)
    first = {min(m, key=lambda x: -1 if x is None else x) for m in members.values()}
    want.append({i: t for i, t in left.items() if i in first})
    want.append(cut(want[-1]))
    dirty = brute_contamination(list(want[-1].items()), items)
    want.append({i: t for i, t in want[-1].items() if not dirty[i][4]})
    assert len(want[0]) > len(want[1]) == len(want[2]) > len(want[3]) and want[1] != want[2]
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == expected, name
    sp = library(model_file())
    final = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}
    assert final == {i: sha256(" ".join(map(str, sp.encode(t) + [2])).encode()).hexdigest() for i, t in want[-1].items()}
    assert {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, sf).collect()} == final


def test_empty_table(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


@pytest.mark.parametrize("n", range(1, 11))
def test_every_operator_is_registered_once(n):
    assert sum(name.startswith(f"op{n}_") for name in QUERIES) == 1

"""Piece codec and decontamination against the library and brute force."""

import random
import re
import struct
from hashlib import sha256

import numpy as np
import pytest

from fieldhouse.llm import decontaminate, piece_codec

DOCS = "doc_id long, text string, lang string, ids string, hits int"


def library(path):
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=path)


def texts(seed=3, n=60):
    pick = random.Random(seed)
    some = ["", None, " ", "  a", "a  ", "▁x ▁", "日本語 🎉", "a\tb\n\n c", "é" * 200, "-" * 4000, "x y " * 3000]
    return some + ["".join(pick.choice("ab ▁é日\n🎉 the ing ") for _ in range(pick.randrange(120))) for _ in range(n)]


def test_op7_equals_library(spark):
    from fieldhouse.llm.queries import model_file

    path, rows = str(model_file()), texts()
    rows += rows[:5]
    docs = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in enumerate(rows)], DOCS)
    own = {r["doc_id"]: r for r in piece_codec.contract(docs, path).collect()}
    full = {r["doc_id"]: r for r in piece_codec.encode(docs, path).collect()}
    sp = library(path)
    for i, t in enumerate(rows):
        ids = sp.encode(t or "") + [2]
        assert own[i]["n_tokens"] == len(ids)
        assert own[i]["ids_sha256"] == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert own[i]["decoded_sha256"] == sha256(sp.decode(ids).encode()).hexdigest()
        assert full[i]["ids"] == ids and full[i]["decoded"] == sp.decode(ids)
        spans = [tuple(s) for s in full[i]["spans"]]
        data = (t or "").encode()
        assert b"".join(data[a:b] for a, b in spans) == data and len(spans) == len(ids)


def test_op7_contract_projects_every_piece(spark):
    from fieldhouse.llm.queries import model_file

    rows = texts() + ["▁ a▁b  c ▁▁ d", " ▁", "a b", "a▁b"]
    docs = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in enumerate(rows)], DOCS)
    full = {r["doc_id"]: r["spans"] for r in piece_codec.encode(docs, str(model_file())).collect()}
    own = {r["doc_id"]: r["spans_sha256"] for r in piece_codec.contract(docs, str(model_file())).collect()}
    for i, t in enumerate(rows):
        data, spans = (t or "").encode(), [tuple(s) for s in full[i]]
        assert own[i] == sha256(b"".join(struct.pack("<ii", *s) for s in spans)).hexdigest()
        assert b"".join(data[a:b] for a, b in spans) == data


def test_summary_projects_through_the_character_map():
    """Rules that lengthen, shorten and drop bytes, with and without removal of extra spaces."""
    from fieldhouse.llm.queries import model_file

    own = piece_codec.PieceCodec(str(model_file()))
    own.map.rules = {"ﬁ".encode(): b"fi", b"abc": b"x", "\u200b".encode(): b"", b"\t": b" "}
    own.map.find = re.compile(b"|".join(map(re.escape, own.map.rules)))
    for own.squeeze in (False, True):
        for text in ["ﬁne abc\u200b  ﬁ\tabcabc", "  abc ▁ﬁ ", "", "\u200b", "x"]:
            data = text.encode()
            n, digits, _, spans = own.summary(data)
            ids = [int(x) for x in digits.split()]
            assert n == len(ids) == len(spans) and ids == own.encode(data) and (spans == own.spans(data, ids)).all()
    own.squeeze = False
    data = "ﬁx abc".encode()
    ids = own.encode(data)
    at = own.spans(data, ids)
    assert at[0][0] == 0 and at[-1].tolist() == [len(data)] * 2
    last = [tuple(x) for x in at.tolist() if x[0] != x[1]][-1]
    assert data[last[0] : last[1]] in (b"abc", b" abc")


def test_character_map_takes_longest_prefix():
    m = piece_codec.CharacterMap(b"")
    m.rules = {b"a": b"x", b"ab": b"yy", b"abc": b""}
    m.find = re.compile(b"|".join(re.escape(k) for k in sorted(m.rules, key=len, reverse=True)))
    new, source = m(b"zabcabaq")
    assert new == b"zyyxq" and source.tolist() == [0, 4, 4, 6, 7, 8]


@pytest.mark.parametrize("rules", ["nfkc", "nmt_nfkc_cf"])
def test_compiled_character_maps_equal_library(rules):
    """The compiled maps of the library's own normalisers, parsed and applied, on texts of all kinds of characters."""
    sentencepiece = pytest.importorskip("sentencepiece")
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rules, add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)
    spec = dict(piece_codec._fields(dict(piece_codec._fields(theirs.serialized_model_proto()))[3]))
    own = piece_codec.CharacterMap(spec[2])
    assert len(own.rules) > 4000
    pick = random.Random(9)
    pools = [(0x20, 0x7F), (0xA0, 0x250), (0x300, 0x370), (0xAC00, 0xD7A0), (0x1100, 0x1200), (0x3300, 0x3400), (0xFB00, 0xFFF0), (0x1F600, 0x1F650), (0x2000, 0x2100)]
    for _ in range(300):
        text = "".join(chr(pick.randrange(*pick.choice(pools))) for _ in range(pick.randrange(1, 40)))
        new, source = own(text.encode())
        assert new.decode() == theirs.normalize(text), text
        if source is not None:  # the alignment runs over the whole text, and never back
            assert len(source) == len(new) + 1 and source[-1] == len(text.encode()) and (source[1:] >= source[:-1]).all()


def test_codec_empty_table(spark):
    from fieldhouse.llm.queries import model_file

    assert piece_codec.contract(spark.createDataFrame([], DOCS), str(model_file())).count() == 0


def brute_contamination(docs, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for i, t in docs:
        words, hit, found = split(t), set(), set()
        for k, item in items:
            w = split(item)
            size = min(n, len(w))
            for a in range(len(w) - size + 1) if w else ():
                for b in range(len(words) - size + 1):
                    if words[b : b + size] == w[a : a + size]:
                        hit |= set(range(b, b + size))
                        found.add(k)
        out[i] = (len(words), len(hit), len(found), sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 300])
def test_op10_equals_brute_force(spark, block_bytes):
    pick = random.Random(5)
    vocabulary = ["The", "cat", "É", "2024", "x", "y", "日本", "Sat"]
    sentence = lambda k: pick.choice([" ", ", ", "\n"]).join(pick.choice(vocabulary) for _ in range(k))
    items = [(k, sentence(pick.choice([0, 2, 5, 11, 14]))) for k in range(12)] + [(90, None), (91, ""), (92, sentence(13))]
    items.append((93, items[-1][1]))
    docs = [(i, sentence(pick.randrange(60)) + " " + (items[i % 12][1] or "") + "." + sentence(4)) for i in range(60)] + [(100, None), (101, ""), (102, "?!"), (103, items[-1][1])]
    d = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(d, b, block_bytes=block_bytes)
    want = brute_contamination(docs, items)
    got = {r["doc_id"]: (r["n_words"], sum(h["end"] - h["start"] for h in r["hits"]), len(r["item_ids"])) for r in found.collect()}
    assert got == {k: v[:3] for k, v in want.items()}
    if block_bytes == decontaminate.BLOCK_BYTES:
        rows = decontaminate.contract(d, b).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows} == want
    kept = decontaminate.decontaminate(d, b, block_bytes=block_bytes)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {k for k, v in want.items() if not v[4]}
    whole = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(d, b, "span").collect()}
    cleaned = decontaminate.decontaminate(d, b, "span", block_bytes=block_bytes)
    assert {r["doc_id"]: r["text"] for r in cleaned.collect()} == whole and cleaned.schema == d.schema
    clean = {k for k, v in want.items() if not v[4]}
    old = dict(docs)
    for r in cleaned.collect():
        assert (r["text"] == old[r["doc_id"]]) == (r["doc_id"] in clean)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 60])
def test_op10_judges_repeated_and_null_ids_by_row(spark, block_bytes):
    items = [(k, f"start{k} " + " ".join(f"w{k}x{j}" for j in range(9))) for k in range(6)]
    texts = ["clean words here", items[0][1], "x " + items[1][1] + " " + items[2][1], "clean again and longer than the others are", None]
    docs = [(i, t) for i in (7, None) for t in texts] + [(7, texts[1]), (8, items[5][1])]
    d = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = [(i, *brute_contamination([(0, t)], items)[0]) for i, t in docs]
    found = [(r["doc_id"], r["n_words"], sum(h["end"] - h["start"] for h in r["hits"]), len(r["item_ids"])) for r in decontaminate.find(d, b, block_bytes=block_bytes).collect()]
    assert sorted(found, key=str) == sorted([w[:4] for w in want], key=str)
    got = [tuple(r) for r in decontaminate.contract(d, b, block_bytes=block_bytes).collect()]
    assert len(decontaminate._blocks(b, 60)) > 1 and sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 40])
def test_op10_items_without_id_are_hits(spark, block_bytes):
    items = [(None, "one two three"), (None, "four five six"), (4, "seven eight nine"), (5, "ten eleven twelve")]
    docs = [(1, "x one two three y four five six"), (2, "seven eight nine one two three"), (3, "clean"), (4, "ten eleven twelve")]
    d = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    digest = lambda x: sha256(x.encode()).hexdigest()
    got = sorted(tuple(r) for r in decontaminate.contract(d, b, block_bytes=block_bytes).collect())
    assert got == [(1, 8, 6, 1, digest(""), True), (2, 6, 6, 2, digest("4"), True), (3, 1, 0, 0, digest(""), False), (4, 3, 3, 1, digest("5"), True)]
    assert [r["doc_id"] for r in decontaminate.decontaminate(d, b, block_bytes=block_bytes).collect()] == [3]


def test_op10_window_hashes_that_clash_are_verified(monkeypatch):
    monkeypatch.setattr(decontaminate, "_hashed", lambda codes, at, size: np.zeros(len(at), np.uint64))
    index = decontaminate.WindowIndex([(1, "a b c"), (2, "d e"), (3, "a b c"), (4, " ".join("abcdefghijkl"))])
    got = list(index.scan([b"x a b c d e", b"", b"a b", b"b c d e f g h i j k l"]))
    assert got == [(6, [(1, 6)], [1, 2, 3]), (0, [], []), (2, [], []), (11, [(0, 11)], [2, 4])]


def test_op10_empty_tables(spark):
    d = spark.createDataFrame([], DOCS)
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contract(d, b).count() == 0
    one = spark.createDataFrame([(1, "a b", "en", "x", 1)], DOCS)
    assert [r["contaminated"] for r in decontaminate.contract(one, b).collect()] == [False]

"""URL rules, sharding, archive and chat formatting against brute force."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from fieldhouse.llm import chat, sharding, url_filter, warc

URLS = [
    None, "", "no scheme", "http://a.com/x", "http://A.COM", "http://com/", "https://www.Example.com/en/1?x=1#y", "https://m.example.com/en/1", "http://example.com/EN/1",
    "http://x.net/es/5", "http://x.net/es", "http://net/fr/", "http://a.org?q=1://b.com/", "http://notexample.com/en/2", "ftp://u@h.example.com:80/en/#z", "http://xcom/", "http://b.net/fr/\n/9",
]


def judged(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in url_filter.RULES:
        own, tail = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best


def test_op1_rules_and_trees(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, label string")
    good = [(f"http://a{i}.org/en/page", 0) for i in range(60)]
    bad = [(f"http://b{i}.info/{i}{i}{i}/x?a={i}&b=2&c=3", 1) for i in range(60)]
    labelled = spark.createDataFrame(good + bad, "url string, label int")
    rows = url_filter.judge(pages, labelled).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path, best = judged(URLS[r["page_id"] % len(URLS)])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        assert r["verdict"] == (best[1] if best else r["learned"]) and r["learned"] in ("allow", "block")
    fresh = spark.createDataFrame([(0, "http://z.info/987/x?a=1&b=2&c=4"), (1, "http://q.org/en/page")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(fresh, labelled).collect()} == {0: "block", 1: "allow"}
    none = labelled.filter("false")
    assert {r["learned"] for r in url_filter.judge(pages, none).collect()} == {"allow"}
    assert url_filter.judge(pages.filter("false"), labelled).count() == 0


def test_op1_trees_of_no_use_block_nothing(spark):
    """Labels that urls say nothing about: the threshold is beyond all probabilities. Useful ones: held-out figures are high."""
    mixed = spark.createDataFrame([(f"http://a{i * 7919 % 1009}.org/p/{i}", int(i % 13 == 5)) for i in range(600)], "url string, label int")
    trees = url_filter.Trees(mixed)
    assert trees.figures.threshold > 1 and trees.figures.rows > 60
    pages = mixed.select(F.col("url"), F.monotonically_increasing_id().alias("page_id"))
    assert {r["verdict"] for r in url_filter.judge(pages, mixed, rules=[]).collect()} == {"allow"}
    plain = spark.createDataFrame([(f"http://a{i}.org/p", 0) for i in range(200)] + [(f"http://b{i}.info/{i}/x?a={i}", 1) for i in range(100)], "url string, label int")
    found = url_filter.Trees(plain).figures
    assert found.precision > 0.95 and found.recall > 0.95
    assert url_filter.chosen({9: (10, 8), 5: (10, 6), 1: (30, 3)}) == url_filter.Figures(50, 17, 5 / url_filter.BINS, 0.7, 14 / 17, (2 * 4 + 4 * 11 + 27 * 15.5) / (17 * 33))


def test_op1_labels_reach_all_forms_of_urls(spark):
    urls = ["http://a/12.html", "http://a/x/12.htm?q", "http://a/12", "http://a/12#z", "http://a/12/", "http://a/12.pdf", "http://a/b", None, "http://a/99999999999999999999999.html", "http://a" + "/xy" * 20000 + "/12.html"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(12, 0, 1), (13, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = [r["url"] for r in url_filter.labelled_pages(pages, labels).collect()]
    assert sorted(got) == sorted(urls[:5] + urls[-1:])


def test_op2_near_equal_and_gapless(spark):
    rows = [(i, "x" * (i * 37 % 500)) for i in range(3000)] + [(5000, None), (5001, ""), (7, "é"), (None, "é"), (None, None), (5002, "long " * 2000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, shard int, size int")
    out = sharding.contract(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    places, loads, owner = defaultdict(list), Counter(), {}
    for r in out:
        places[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
        assert owner.setdefault(r["virtual_slot"], r["shard"]) == r["shard"]
    assert set(places) == set(range(16)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(loads.values()) - min(loads.values()) <= max(r["size"] for r in out)
    small = sharding.placed(docs, window_rows=1)
    again = defaultdict(list)
    for r in small.collect():
        again[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in again.values())
    assert sharding.contract(docs.filter("false")).count() == 0


def test_op2_rebalancing_moves_little(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), (F.col("id") % 90).cast("int")).alias("text"))
    loads = sharding.slot_bytes(sharding.records(docs, 256), 256).cache()
    old = sharding.slot_map(loads, 4).cache()
    for shards in (5, 3):
        new = sharding.rebalanced(old, loads, shards).collect()
        was, size = {r["virtual_slot"]: r["shard"] for r in old.collect()}, {r["virtual_slot"]: r["bytes"] for r in loads.collect()}
        assert len(new) == 256 and {r["version"] for r in new} == {2} and {r["shard"] for r in new} == set(range(shards))
        moved = sum(size[r["virtual_slot"]] for r in new if was[r["virtual_slot"]] != r["shard"])
        assert moved <= 0.4 * sum(size.values())
        load = Counter()
        for r in new:
            load[r["shard"]] += size[r["virtual_slot"]]
        assert max(load.values()) <= 1.1 * sum(size.values()) / shards


def test_op2_map_versions_are_stored_and_edited(spark, tmp_path):
    path = str(tmp_path / "map")
    rows = sharding.records(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text")), 128)
    first = {r["virtual_slot"]: r["shard"] for r in sharding.saved(sharding.slot_map(sharding.slot_bytes(rows, 128), 4), path).collect()}
    second = {r["virtual_slot"]: r["shard"] for r in sharding.rebalance(rows, path, 5, 128).collect()}
    third = {r["virtual_slot"]: r["shard"] for r in sharding.rebalance(rows, path, 5, 128).collect()}
    versions = {r["version"] for r in spark.read.parquet(path).select("version").distinct().collect()}
    assert versions == {1, 2, 3} and len(first) == len(second) == len(third) == 128 and set(second.values()) == set(range(5))
    assert sum(first[k] == second[k] for k in first) >= 90 and sum(second[k] == third[k] for k in second) >= 120
    assert {r["virtual_slot"]: r["shard"] for r in sharding.stored(spark, path, 1).collect()} == first
    placed = sharding.numbered(rows, sharding.stored(spark, path), 128).collect()
    assert len(placed) == 3000 and all(r["shard"] == third[r["virtual_slot"]] and r["version"] == 3 for r in placed)


def test_op2_many_equal_ids_are_dealt_out(spark):
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    out = sharding.placed(docs, slots=1, window_rows=100).collect()
    assert len({r["part"] for r in out}) == 20 and sorted(r["slot"] for r in out) == list(range(2000))


@pytest.mark.parametrize("ids", ["if(id % 2 = 0, null, id)", "cast(7 as long)", "cast(null as long)"])
def test_op2_null_and_equal_ids_keep_the_law(spark, ids):
    """Half of the ids null, one id on all rows, no ids; a third of the rows equal in everything."""
    docs = spark.range(6000).selectExpr(f"{ids} as doc_id", "if(id % 3 = 0, 'hot copy', repeat('a', cast(id % 300 as int))) as text")
    if ids.startswith("if"):
        docs = docs.unionByName(docs.selectExpr("cast(null as long) doc_id", "'hot copy' text"))
    out = sharding.contract(docs).collect()
    loads, places = Counter(), defaultdict(list)
    for r in out:
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert Counter(r["size"] for r in out) == Counter(r["n"] for r in docs.selectExpr("octet_length(text) + 1 n").collect())
    assert set(places) == set(range(16)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(loads.values()) - min(loads.values()) <= 300


def test_op3_missing_payload_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "ab"[i % 2] * 200) for i in range(9)], "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    assert warc.read_archive(spark, path).count() == 9
    kept = [tuple(r) for r in spark.read.parquet(path + "/payloads").collect()][:1]
    spark.createDataFrame(kept, "digest string, payload binary").write.mode("overwrite").parquet(path + "/payloads")
    with pytest.raises(Exception, match="missing payload"):
        warc.read_archive(spark, path).collect()


def test_op3_urls_stand_beside_headers_as_they_came(spark, tmp_path):
    urls = ["http://a/\nb", "http://a/%0Ab", None, "", "http://a/%20\r"]
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string"), path)
    rows = {r["page_id"]: r for r in warc.reconstruct(spark, path).collect()}
    assert [rows[i]["url"] for i in range(5)] == urls and all(rows[i]["header"].count("\r\n\r\n") == 1 for i in rows)


def test_op3_corrupt_store_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a" * 200), (2, "u", "b" * 200), (None, "u", "a" * 200)], "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in warc.read_archive(spark, path).collect()) == [(0, "revisit"), (1, "response"), (2, "response")]
    stored = [tuple(r) for r in spark.read.parquet(path + "/payloads").collect()]
    spark.createDataFrame([(d, b.replace(b"b", b"c")) for d, b in stored], "digest string, payload binary").write.mode("overwrite").parquet(path + "/payloads")
    with pytest.raises(Exception, match="corrupt payload"):
        warc.read_archive(spark, path).collect()


def test_op8_own_conversation_stays_apart(spark):
    table = spark.createDataFrame([(-1, 0, "user", "x"), (3, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    got = sorted((r["conv_id"], r["n_turns"], r["loss_chars"]) for r in chat.contract(table).collect())
    assert got == [(-1, 1, 0), (-1, 2, 21), (3, 1, 0)]


def test_op3_archive(spark, tmp_path):
    long, other = "é" * 60, "<p>" + "z" * 300
    rows = [(5, "http://a", long), (3, "http://b\r\nX: y", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (8, "u", other), (7, "u", other)]
    pages = spark.createDataFrame([(i, u, h, "d") for i, u, h in rows], "page_id long, url string, html string, digest string")
    got = {r["page_id"]: tuple(r)[1:] for r in warc.contract(pages).collect()}
    firsts = {}
    for i, _, h in rows:
        d = sha256((h or "").encode()).hexdigest()
        firsts[d] = min(firsts.get(d, i), i)
    for i, _, h in rows:
        data = (h or "").encode()
        d = sha256(data).hexdigest()
        response = len(data) < 100 or firsts[d] == i
        assert got[i] == (len(data), d, "response" if response else "revisit", None if response else firsts[d])
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    assert spark.read.parquet(path + "/payloads").count() == len(firsts)
    for r in warc.reconstruct(spark, path).collect():
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        html = next(h for i, _, h in rows if i == r["page_id"]) or ""
        assert head.startswith(b"WARC/1.1\r\n") and bytes(r["payload"]) == html.encode()
        assert body == (html.encode() if b"WARC-Type: response" in head else b"") + b"\r\n\r\n"
        assert f"Content-Length: {len(body) - 4}".encode() in head
    twice = pages.union(pages)
    assert len({tuple(r) for r in warc.contract(twice).collect()}) == len(rows) and warc.contract(twice).count() == 2 * len(rows)
    assert warc.contract(pages.filter("false")).count() == 0


def test_op8_round_trip(spark):
    texts = ["hello", "", None, "</s>[INST] ok [/INST]", "\\", "a\\", "\\\\</s>\\", "<\\s>", "[[INST]", "<</s>", "x</s", "s>", "<s>\n[/INST]</s>", "日本🎉", "$1 \\1", "[INST", "word " * 5000]
    roles = ["user", "assistant", None, "a[INST]b", "system", "</s>"]
    rows = [(c, t, roles[(c + t) % len(roles)], texts[(c * 7 + t) % len(texts)]) for c in range(30) for t in range(5)] + [(50, 1, "assistant", "b"), (50, 1, "assistant", "a"), (50, 1, "assistant", "a"), (None, None, None, None)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    full = {r["conv_id"]: r for r in chat.format_conversations(table).collect()}
    got = {r["conv_id"]: r for r in chat.contract(table).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows + [(-1, 0, "user", texts[3]), (-1, 1, "assistant", texts[3])]:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha256(loss.encode()).hexdigest())
        if c != -1:
            assert full[c]["identical"] and len(full[c]["formatted"]) == got[c]["formatted_chars"]
            assert full[c]["formatted"].count("</s>") == len(turns) == full[c]["formatted"].count("[/INST]") == full[c]["formatted"].count("<s>")
    assert chat.contract(table.filter("false")).count() == 1

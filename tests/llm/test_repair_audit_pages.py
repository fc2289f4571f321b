"""Conversation repair, divergence of sources and main texts against brute force and small fixtures."""

import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from hashlib import sha256
from html.parser import HTMLParser
from itertools import product

import pyarrow as pa
import pytest

from fieldhouse.llm import divergence, main_text, turn_repair

GRAMMAR, PREFIX = re.compile("(s?(ua)+)?"), re.compile("s?(ua)*u?")


def cheapest(initials, kinds):
    """All edits tried; at most two insertions in one place can be of use."""

    @lru_cache(None)
    def least(i, told, inserted):
        found = [(0, "")] if i == len(kinds) and GRAMMAR.fullmatch(told) else []
        steps = [(i, c, "I", 2) for c in "ua"] if inserted < 2 else []
        if i < len(kinds):
            steps.append((i + 1, "", "D", 3))
            if kinds[i] != turn_repair.LOST:
                steps += [(i + 1, c, letter, cost + kinds[i]) for c, letter, cost in ((initials[i], "K", 0), ("u", "R", 2), ("a", "R", 2)) if c]
        for to, c, letter, cost in steps:
            if PREFIX.fullmatch(told + c):
                rest = least(to, told + c, inserted + 1 if letter == "I" else 0)
                if rest:
                    found.append((rest[0] + cost, letter + rest[1]))
        return min(found, default=None)

    return least(0, "", 0)


def test_op11_search_equals_all_edits():
    pick = random.Random(5)
    for _ in range(1500):
        n = pick.randrange(8)
        initials, kinds = [pick.choice(["s", "u", "u", "a", "a", " ", "x", ""]) for _ in range(n)], bytes(pick.choice([0, 0, 0, 1, 2]) for _ in range(n))
        assert turn_repair.cheapest(initials, kinds) == cheapest(tuple(initials), kinds)


def test_op11_long_conversation():
    n = 30_000
    cost, audit = turn_repair.cheapest(["u", "a"] * n + ["u"], bytes([0]) * (2 * n + 1))
    assert (cost, audit) == (2, "K" * (2 * n + 1) + "I")


def brute_repair(rows):
    """The contract's row for each conversation, from the original rows."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        role, text, kind = said(role), said(text), zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        own = groups[conv]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        kinds, faults, seen = [], Counter(), set()
        for _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            kinds.append({"": 0, "truncated": 1}.get(fault, 2))
        initials = [r[1][:1] for r in own]
        cost, audit = cheapest(tuple(initials), bytes(kinds))
        length = sum(c != "D" for c in audit)
        names = (["system"] if length % 2 else []) + ["user", "assistant"] * (length // 2)
        lines, at = [], 0
        for c in audit:
            if c != "D":
                name = names[len(lines)]
                lines.append(f"{own[at][1] if c == 'K' else name}:{'' if c == 'I' else own[at][2]}")
            at += c != "I"
        turns = {r[0] for r in own if r[0] is not None}
        out[conv] = {
            "conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": faults["blank"], "duplicate": faults["duplicate"], "truncated": faults["truncated"],
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit, "repaired_sha256": sha256("\n".join(lines).encode()).hexdigest(),
        }
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, audit string, present boolean, kind int"


def test_op11_equals_brute_force(spark):
    pick = random.Random(6)
    roles, texts = ["system", "user", "assistant", "user", "assistant", None, "tool", ""], ["Yes.", "No", "", None, " \t", "Why?", "日本。", "a\nb!", "x" * 5000 + "."]
    rows = [(pick.choice([None, *range(40)]), pick.choice([None, 0, 1, 2, 3, 4, 9]), pick.choice(roles), pick.choice(texts)) for _ in range(260)]
    # a conversation of a single row that the damage drops
    gone = next((c, t) for c, t in product(range(1000, 1100), range(3)) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    rows += rows[:30] + [(*gone, "user", "Yes.")]
    # a null conversation of many rows would take the brute force too long
    rows = [r for r in rows if r[0] is not None] + [(None, None, "user", "a."), (None, 1, None, None), (None, 1, "assistant", "b")]
    table = spark.createDataFrame([(*r, "x", None, 1) for r in rows], CONVERSATIONS).repartition(5)
    found = {r["conv_id"]: r.asDict() for r in turn_repair.contract(table).collect()}
    assert found == brute_repair(rows)
    empty = sha256(b"").hexdigest()
    assert found[gone[0]] == {"conv_id": gone[0], "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": empty}
    assert turn_repair.contract(table.filter("false")).count() == 0


def test_op11_repair_returns_turns(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "cut"), (2, 0, "system", "Be good."), (2, 1, "assistant", "Hi.")]
    found = {r["conv_id"]: r for r in turn_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (found[1]["audit"], found[1]["cost"], [tuple(t) for t in found[1]["repaired"]]) == ("KD", 3, [("user", "Hello.")]) or found[1]["audit"] == "KR"
    assert [tuple(t) for t in found[2]["repaired"]] == [("system", "Be good."), ("user", ""), ("assistant", "Hi.")]


def test_op11_hot_null_conversation(spark):
    """A third of all rows in one conversation, over many partitions."""
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, null, id div 4) conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('t', id, '.') text").repartition(7)
    found = turn_repair.repair(rows)
    assert found.filter("conv_id is null").count() == 1
    hot = found.filter("conv_id is null").first()
    assert len(hot["audit"]) >= 10_000 and hot["blank"] == hot["duplicate"] == hot["truncated"] == 0
    assert found.selectExpr("sum(length(replace(audit, 'I')))").first()[0] == 30_000


def words_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute_audit(docs, least, top):
    docs = [(a or "", b or "", words_of(t)) for a, b, t in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        often = Counter(w for d in own for w in set(d[2]))
        kept = sorted(w for w in often if often[w] >= least)

        def shares(rows):
            counts = Counter(w for r in rows for w in r[2])
            total = sum(counts[w] for w in kept)
            return {w: 1 + (10**9 * (counts[w] + 5)) // (total + 5 * len(kept)) for w in kept}, counts

        q, _ = shares(own)
        of = {s: shares([d for d in own if d[1] == s]) for s in {d[1] for d in own}}
        for s, (p, counts) in of.items():
            pairs = [(o, sum(abs(p[w] - of[o][0][w]) for w in kept)) for o in of if o != s]
            terms = [(w, p[w] - q[w]) for w in kept if counts[w] and p[w] > q[w]]
            for part, rows in (("pair", pairs), ("term", terms)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(rows) if part == "pair" or k < top]
    return sorted(out)


DOCS = "doc_id long, text string, lang string, source string, term string, n long, copies int"


@pytest.mark.parametrize("least", [1, 3, 1000])
def test_op12_equals_brute_force(spark, least):
    pick = random.Random(7)
    said = ["a", "b", "É", "étE", "the", "The", "it's", "x9y", "日本", "zz", "..", "123"]
    texts = [None, "", " ", "42 !"] + [" ".join(pick.choices(said, [9, 7, 5, 4, 3, 3, 2, 2, 1, 1, 1, 1], k=pick.randrange(1, 30))) for _ in range(60)] + ["the word " * 4000]
    docs = [(pick.choice(["en", "fr", None, ""]), pick.choice(["s1", "s2", "S3", None, "é"]), pick.choice(texts)) for _ in range(300)]
    docs += [("en", "s1", "hot text A a")] * 150 + [("solo", "one", None)]
    table = spark.createDataFrame([(None if i % 9 else i, t, a, b, "x", 1, 2) for i, (a, b, t) in enumerate(docs)], DOCS).repartition(6)
    found = divergence.audit(table, least, 4)
    assert sorted(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()) == brute_audit(docs, least, 4)


def test_op12_collapses_copies_and_takes_empty_tables(spark):
    table = spark.createDataFrame([(i, "same text", "en", f"s{i % 3}", "x", 1, 1) for i in range(900)], DOCS).repartition(5)
    rows = divergence.collapsed(table).collect()
    assert len(rows) == 1 and sorted(tuple(c) for c in rows[0]["copies"]) == [("s0", 300), ("s1", 300), ("s2", 300)]
    assert divergence.contract(table.filter("false")).count() == 0


def test_op12_takes_no_python_step_for_each_word():
    """200 texts of the same 300 words, in other orders: the lines of Python that run grow with texts and sums, not with the
    60,000 words."""
    words = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmno"]
    texts = [" ".join(words[k:] + words[:k]) for k in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 200), pa.array(texts), pa.array([[{"source": "s", "n": 1}]] * 200)], ["lang", "text", "copies"])
    steps = 0

    def traced(frame, event, arg):
        nonlocal steps
        steps += event == "line" and frame.f_code.co_filename == divergence.__file__
        return traced

    before = sys.gettrace()
    sys.settrace(traced)
    try:
        out = list(divergence._tallied(iter([batch])))
    finally:
        sys.settrace(before)
    sums = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert sorted(sums) == sorted(("en", "s", w, 200, 200) for w in words)
    assert steps < 10_000


@pytest.mark.parametrize("most", [1, 50, 10**6])
def test_op12_tallies_words_of_every_character(monkeypatch, most):
    """Characters of every kind, copies of several sources, and sums that are passed on before the end."""
    monkeypatch.setattr(divergence, "MOST_HELD", most)
    signs = [chr(k) for k in range(256)] + ["\u0130", "\u212a", "\u2028", "\u3000", "\uffff", "\U0001f600"]
    texts = ["", "".join(signs), "".join(f"a{c}B" for c in signs), " ".join(f"Z{c} z{c}" for c in signs)]
    copies = [[{"source": "s", "n": 1}], [{"source": "s", "n": 1}, {"source": "t", "n": 3}], [{"source": "t", "n": 2}], [{"source": "", "n": 1}, {"source": "s", "n": 1}]]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en", "en", ""]), pa.array(texts), pa.array(copies)], ["lang", "text", "copies"])
    counts, docs = Counter(), Counter()
    for lang, text, found in zip(["en", "en", "en", ""], texts, copies):
        for copy in found:
            for w, times in Counter(words_of(text)).items():
                counts[lang, copy["source"], w] += times * copy["n"]
                docs[lang, w] += copy["n"]
    for_groups, for_langs = Counter(), Counter()
    for b in divergence._tallied(iter([batch])):
        for r in b.to_pylist():
            for_groups[r["lang"], r["source"], r["term"]] += r["count"]
            for_langs[r["lang"], r["term"]] += r["docs"]
    assert for_groups == counts and for_langs == docs


def page(body):
    return f'<!DOCTYPE html><html><head><title>No</title><style>p{{margin:0}}</style><script>var t="<p>no</p>";</script></head><body class="with-sidebar">{body}</body></html>'


LONG = "This sentence is long enough to be the text of an article, and it says so in many plain words."
MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
PAGES = [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>", ""), (page(""), ""),
    (page(f"{MENU}<article><h1>Head &amp; all</h1><p><b>One\n  two<br>three<p>Er.</p></article><footer>&copy; foot</footer>"), "Head & all\n\nOne two three\n\nEr."),
    (page(f"<header><a href='/'>Logo</a> Slogan</header><main><p>{LONG}</p><div class='ad'>Buy it now.</div><p>Er.</p><aside>Side</aside><form>Name <input></form><p>&lt;b&gt; &#8364;&nbsp;5</p></main>"), f"{LONG}\n\nEr.\n\n<b> € 5"),
    (page(f"<div id='menu'>Home News</div><div class='cookie-notice'>We use cookies and like them very much, as this long notice about cookies tells you at length.</div><div><h1>Head</h1><p>{LONG}</p><p>Er.</p></div><div class='comments'><p>{LONG} says a reader.</p></div><div class='footer'>End</div>"), f"Head\n\n{LONG}\n\nEr."),
    (page(f"<ul><li><a href='/'>One</a></li><li><a href='/x'>Two</a></li></ul><p>{LONG}</p><p>See <a href='/y'>there</a>.</p><ul><li><a href='/1'>1</a></li><li><a href='/2'>2</a></li></ul>"), f"{LONG}\n\nSee there."),
    (page(f"<article><header><h1>Head</h1></header><ul><li>one</li><li>two</li></ul><table><tr><td>a</td><td>b</td></tr></table><section class='comments'><p>{LONG}</p></section></article>"), "Head\n\none\n\ntwo\n\na b"),
    (page(f"<nav>never closed<div><article><p>{LONG}</p></article></div>"), LONG),
    (page(f"<article><p>{LONG}</p><p>end"), f"{LONG}\n\nend"),
    (page(f"<article><p>{LONG}</p></article><aside><article><p>Teaser</p></article></aside><article class='teaser'><p>Other</p></article>"), LONG),
    (page(f"<div class='main-with-sidebar'><article><p>{LONG} a < b</p><!-- no <p>no</p> --></article></div>"), f"{LONG} a < b"),
    (f"<article><p>{LONG}</p><p>a < b</p><p>cut <a href='/x", f"{LONG}\n\na < b\n\ncut"),
    (page(f"<form action='/x'><div class='share-on'><h1>Head</h1><p>{LONG}</p></div><input></form>"), f"Head\n\n{LONG}"),
    (page(f"<article><p>{LONG}</p><span class='ad'>Buy<p>Er.</p></article>"), f"{LONG}\n\nEr."),
    (page("<article><p>Er.</p><p>End <span class='ad'>Buy.</span> here.</p></article>"), "Er.\n\nEnd here."),
    (page("<article><p>Short.</p><div style='display:none'>Hidden</div><p hidden>Gone</p><p>Seen.</p></article>"), "Short.\n\nSeen."),
]


def test_op13_pages(spark):
    rows = [(i, f"http://h/{i}", html, "x", 1) for i, (html, _) in enumerate(PAGES)]
    found = main_text.contract(spark.createDataFrame(rows + rows[3:5], "page_id long, url string, html string, text string, n_chars int")).collect()
    assert len(found) == len(rows) + 2
    for r in found:
        assert (r["text"], r["n_chars"], r["url"]) == (PAGES[r["page_id"]][1], len(PAGES[r["page_id"]][1]), f"http://h/{r['page_id']}")
    assert main_text.contract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


class Article(HTMLParser):
    """Texts of an article's blocks by the standard library's parser, for pages with one marked article and nothing else in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.blocks[-1:] = [self.blocks[-1] + " "] if tag == "br" else [self.blocks[-1], ""] if tag in ("p", "h1", "article", "li", "ul") else self.blocks[-1:]

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1", "article", "li", "ul"):
            self.blocks.append("")

    def handle_data(self, data):
        self.blocks[-1] += data if self.inside else ""


def test_op13_equals_a_parser_on_random_articles():
    pick = random.Random(8)
    for _ in range(200):
        parts = []
        for _ in range(pick.randrange(1, 12)):
            said = " ".join(pick.choices(["Er.", "a &amp; b", "&lt;p&gt;", "é", "x\n y", "<b>bold</b>", "<br>", "<a href='/q?x=1&y=2'>link</a>", "&quot", "long words and more of them"], k=pick.randrange(1, 9)))
            parts.append(pick.choice(["<p>{}</p>", "<p>{}", "<h1>{}</h1>", "<ul><li>{}</li><li>more</li></ul>"]).format(said))
        html = page(f"{MENU}<div class='ad'>Buy.</div><article>{''.join(parts)}</article><footer>foot</footer>")
        parser = Article()
        parser.feed(html)
        assert main_text.main_text(html) == "\n\n".join(t for b in parser.blocks if (t := " ".join(b.split())))


def test_op13_long_and_odd_pages_take_linear_time():
    for html in ("<p>a " * 50_000, "<div>" * 50_000 + "x", "<a '" * 20_000, "<" * 50_000, "<!--" * 20_000, "<script>" * 5_000, page("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>")):
        main_text.main_text(html)

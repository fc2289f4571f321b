"""Main text of web pages by line-block distribution.

Markup is stripped into lines: each block element starts a line, white space inside one is a single space, and character
references are decoded after the tags are gone. An element that is no article text by its name, role or class (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments, hidden elements) leaves WINDOW empty lines in its place,
so does a run of two lines or more that are nothing but links. The block of a line is the sum of text lengths, link texts
left out, over the WINDOW lines that begin there. Text begins where blocks surge (above SURGE code points) and ends where
they dive to nothing; all lines between a surge and its dive are kept, short ones too.

Where a page marks its article (`article`, `main`, or that role), lines elsewhere are empty and any block above nothing is a
surge, so nothing of a marked article is dropped; of several articles those with a surge above SURGE are kept. Where no
block surges, the lines around the largest block are kept.

A header inside an article is the article's heading and stays unless it is a menu. What holds the article or a main heading
is no menu or notice whatever its class says, nor a form. Containers that are never closed end at the next container tag,
other elements at the next block. Null html is empty; a page without text gives an empty text. Repeated rows and page_ids are pages
of their own; no row meets another, so very long pages or empty tables need nothing special. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhouse.llm.util import small_batches, trimmed

#: Lines in a block, and code points of text that make a surge where the page does not mark its article.
WINDOW, SURGE = 3, 80

_RAW = "script|style|noscript|template|textarea|title|iframe|object|svg|math|select|noframes|xmp"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|</?([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|\Z)", re.I)
CONTAINERS = frozenset("article main section div nav header footer aside form ul ol dl table blockquote figure details dialog fieldset center menu search".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr caption figcaption pre address hr legend summary body html head thead tbody tfoot option optgroup hgroup".split())
CELLS = frozenset(["td", "th", "br"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, roles and class or id words of what is no article text.
OTHER = frozenset("nav header footer aside form dialog menu search button label".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
WORDS = frozenset(
    """ad ads advert adverts advertisement advertising advertorial adsense banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar footer
    masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments disqus replies related recommended
    recommendations share sharing social pagination pager widget widgets copyright""".split()
)
#: Words that, inside an article, belong to its own heading.
HEADINGS = frozenset(["header", "site-header", "banner", "masthead"])
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _kind(name: str, attributes: str, inside: bool) -> str | None:
    """`article` where an element marks the article, `other` where it is no article text."""
    marks = {a.lower(): (x or y or z or "") for a, x, y, z in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    role = marks.get("role", "").lower()
    if "hidden" in marks or marks.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", marks.get("style", ""), re.I):
        return "other"
    if name in ("article", "main") or role in ("article", "main") or marks.get("itemprop", "") == "articleBody":
        return "article"
    if role in ROLES or (name in OTHER and not (inside and name == "header")):
        return "other"
    if name in ("body", "html", "head"):
        return None
    words = {w.lower() for w in _WORD.findall(f"{marks.get('class', '')} {marks.get('id', '')}")}
    if not inside and "header" in words:
        return "other"
    return "other" if words & (WORDS - HEADINGS if inside else WORDS) else None


def _tags(html: str) -> tuple[list[tuple], dict[int, int]]:
    """The page as (text before, name, attributes, closing, self-closed) and, for each container's place, that of its end."""
    tags, at = [], 0
    closed = html.rfind(">") + 1
    cut = _OPEN.search(html, closed)  # a tag that the page's end cuts off is no text
    html = html[: cut.start()] if cut else html
    for m in _TOKEN.finditer(html):
        name = (m[2] or m[4] or "").lower()
        tags.append((html[at : m.start()], name, m[3] or m[5] or "", html[m.start() + 1] == "/", m[0].endswith("/>")))
        at = m.end()
    tags.append((html[at:], "", "", False, False))
    ends, open_ = {}, []
    have = Counter()
    for k, (_, name, _, closing, _) in enumerate(tags):
        if name in CONTAINERS:
            if not closing:
                open_.append((name, k))
                have[name] += 1
            elif have[name]:
                while True:
                    own, began = open_.pop()
                    have[own] -= 1
                    if own == name:
                        ends[began] = k
                        break
    return tags, ends


def lines_of(html: str) -> tuple[list[tuple[str, int, int]], bool]:
    """(text, length without link texts, number of the article or -1) for each line, and whether the page marks one."""
    tags, ends = _tags(html)
    marks = [0]  # articles and main headings before each tag: what holds one is no menu, whatever its class says
    for _, name, _, closing, _ in tags:
        marks.append(marks[-1] + (not closing and name in ("article", "main", "h1")))
    last_close = {name: k for k, (_, name, _, closing, _) in enumerate(tags) if closing}
    lines: list[tuple[str, int, int]] = []
    parts: list[str] = []
    own = links = articles = 0
    article, article_end = -1, -1
    skip_name, skip_depth, skip_end = "", 0, -1

    def end_line() -> None:
        nonlocal own
        text = " ".join(unescape("".join(parts)).split())
        if text:
            lines.append((text, own, article))
        parts.clear()
        own = 0

    def empty() -> None:
        end_line()
        lines.extend([("", 0, -1)] * WINDOW)

    for k, (text, name, attributes, closing, alone) in enumerate(tags):
        if skip_end < 0 and not skip_name and text:
            parts.append(text)
            if not links:
                own += len(" ".join(unescape(text).split()))
        if skip_end >= 0:
            if k < skip_end:
                continue
            skip_end = -1
            if closing:  # the end tag of the skipped element itself
                continue
        if skip_name:
            if name == skip_name and not alone:
                skip_depth += -1 if closing else 0 if name in ("p", "li") else 1
                if skip_depth == 0 or (not closing and name in ("p", "li")):
                    skip_name = ""
                    if closing:
                        continue
            elif name in CONTAINERS or (name in BLOCKS and (skip_name == "p" or last_close.get(skip_name, -1) < k)):
                skip_name = ""
            if skip_name:
                continue
        if not name:
            continue
        if name in BLOCKS:
            end_line()
            links = 0
        elif name in CELLS:
            parts.append(" ")
        if k == article_end:
            article, article_end = -1, -1
            lines.extend([("", 0, -1)] * WINDOW)
        if name == "a":
            links = int(not closing)
        if closing or name in VOID:
            continue
        kind = _kind(name, attributes, article >= 0)
        if kind == "article" and article < 0:
            lines.extend([("", 0, -1)] * WINDOW)
            article, articles, article_end = articles, articles + 1, ends.get(k, len(tags))
        elif kind == "other" and not alone:
            if name in CONTAINERS:
                end = ends.get(k)
                if end is None:  # never closed: up to the next container tag
                    end = next((j for j in range(k + 1, len(tags)) if tags[j][1] in CONTAINERS), len(tags) - 1)
                    skip_name, skip_depth = ("", 0) if end == k + 1 else (name, 1)
                    empty()
                elif (name in OTHER and name != "form") or marks[end] == marks[k + 1]:
                    skip_end = end
                    empty()
            else:
                skip_name, skip_depth = name, 1
                if name in BLOCKS:
                    empty()
    end_line()
    return lines, articles > 0


def _without_link_runs(lines: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Outside marked articles, two or more neighbouring lines of links alone are a menu."""
    only = [bool(text) and not own for text, own, _ in lines]
    return [
        ("", 0, -1) if only[i] and ((i and only[i - 1]) or (i + 1 < len(only) and only[i + 1])) else line
        for i, line in enumerate(lines)
    ]


def _between(lines: list[tuple[str, int, int]], surge: int) -> list[str]:
    """Texts from each surge to its dive; if there is none, around the largest block."""
    lengths = [own or int(bool(text)) for text, own, _ in lines]
    total, sums = 0, [0] * len(lengths)
    for i in range(len(lengths) - 1, -1, -1):
        total += lengths[i] - (lengths[i + WINDOW] if i + WINDOW < len(lengths) else 0)
        sums[i] = total
    regions, i = [], 0
    while i < len(sums):
        if sums[i]:
            end = i
            while end < len(sums) and sums[end]:
                end += 1
            regions.append((max(sums[i:end]), i, end))
            i = end
        i += 1
    chosen = [r for r in regions if r[0] > surge] or ([max(regions, key=lambda r: (r[0], -r[1]))] if regions else [])
    return [text for _, start, end in chosen for text, *_ in lines[start:end] if text]


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks in page order, with an empty line between them."""
    lines, marked = lines_of(html or "")
    if not marked:
        return "\n\n".join(_between(_without_link_runs(lines), SURGE))
    within = [line if line[2] >= 0 else ("", 0, -1) for line in lines]
    groups = sorted({a for _, _, a in within if a >= 0})
    if len(groups) > 1:  # the page's article, not teasers of others: those with a surge, if any has one
        surging = [a for a in groups if sum(own for _, own, b in within if b == a) > SURGE]
        within = [line if line[2] in (surging or groups) else ("", 0, -1) for line in within]
    return "\n\n".join(_between(within, 0))


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html) for html in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(trimmed(_pages), "page_id long, url string, text string, n_chars long")


def contract(pages: DataFrame) -> DataFrame:
    """The columns of op13."""
    return extract(pages)


#: For pages of the given tables' markup: one article, whose tags are blocks, line breaks or emphasis at a block's ends.
ORACLE_SQL = r"""
WITH article AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS html FROM pages),
blocks AS (SELECT page_id, url, list_transform(regexp_split_to_array(replace(html, '<br>', ' '), '<[^>]*>'), lambda x:
  trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&apos;|&#39;', '''', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) AS parts FROM article),
texts AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: regexp_replace(x, '&amp', '&', 'g')), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM blocks)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""

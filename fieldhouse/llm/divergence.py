"""Divergence of sources within a language, over texts collapsed to their distinct forms.

Equal texts of a language become one row with a count for each source that has them; that row is tokenised once. Each of
its terms then adds to every source's occurrences and documents by that count, so a text with a million copies costs one
tokenisation. A language keeps the terms of LEAST documents or more.

All numbers are integers. For a kept term with count c in a group of N kept occurrences, p = 1 + floor(SCALE * (c + 5) /
(N + 5 V)) over the V kept terms. A term that a group does not have has the group's p of count 0, so two sources are
compared over the terms that they have only: with a0, b0 the p of count 0, the sum of |a - b| over all V terms is

    V |a0 - b0| + sum over a's terms (|a - b0| - |a0 - b0|) + sum over b's terms (|a0 - b| - |a0 - b0|)
      + sum over shared terms (|a - b| - |a - b0| - |a0 - b| + |a0 - b0|).

Shared terms meet in an equality join on (lang, term) of the counts after aggregation, each pair of sources once; its rows
grow with the vocabulary and the pairs of sources, which are the result's rows too, not with the documents.

Null text, lang and source read as empty strings. Repeated rows are copies like others; an empty table gives an empty result.
A very long text is a row like any other: its words are added up where it was read. Other columns are ignored. Texts of equal
SHA-256 are taken as equal.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldhouse.llm.util import byte_values, small_batches, trimmed, written

#: Documents of its language that a kept term has at least; added to each count; the whole of p; terms reported for a group.
LEAST, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Sums that a task holds at a time.
MOST_HELD = 300_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of words as they count, a space for each byte between words.
_AS_WORDS = bytes(b if b > 0x7F or chr(b) in LOWER else ord(LOWER[b - 65]) if chr(b) in UPPER else 32 for b in range(256))


def collapsed(docs: DataFrame) -> DataFrame:
    """lang, text, and copies: how often each source has that text. Rows are counted by digest, and of each digest one text
    travels; both are combined where they are read, so that a hot text is no hot key."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(said("lang"), said("text"), said("source")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    counted = rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"))
    copies = counted.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    texts = rows.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    return texts.join(copies, ["lang", "digest"]).select("lang", "text", "copies")


def words_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: every byte above 0x7F belongs to a word, so all of it can be done on bytes."""
    return text.translate(_AS_WORDS).split()


class _Tally:
    """Occurrences by (lang, source) and term, documents by lang and term."""

    def __init__(self) -> None:
        self.occurrences: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.documents: dict[str, Counter] = defaultdict(Counter)
        self.held = 0

    def add(self, lang: str, text: bytes, copies: list[dict]) -> None:
        words = words_of(text)
        groups = [(self.occurrences[lang, copy["source"]], copy["n"]) for copy in copies]
        before = sum(len(own) for own, _ in groups)
        documents, times = self.documents[lang], sum(n for _, n in groups)
        if times == 1:
            groups[0][0].update(words)
            documents.update(set(words))
        else:
            found = Counter(words)
            for term, count in found.items():
                documents[term] = documents.get(term, 0) + times
                for own, n in groups:
                    own[term] = own.get(term, 0) + count * n
        self.held += sum(len(own) for own, _ in groups) - before

    def flushed(self) -> pa.RecordBatch:
        """A row for each sum. The documents of a term stand in one of its language's rows."""
        langs, sources, terms, counts, docs = [], [], [], [], []
        for (lang, source), own in self.occurrences.items():
            langs += [lang] * len(own)
            sources += [source] * len(own)
            terms += own
            counts += own.values()
            left = self.documents[lang].pop
            docs += [left(term, 0) for term in own]
        self.occurrences.clear()
        self.documents.clear()
        self.held = 0
        columns = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(docs, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "count", "docs"])


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = _Tally()
    for batch in batches:
        for lang, text, copies in zip(batch.column("lang").to_pylist(), byte_values(batch.column("text")), batch.column("copies").to_pylist()):
            tally.add(lang, text, copies)
            if tally.held >= MOST_HELD:
                yield tally.flushed()
    yield tally.flushed()


def term_counts(texts: DataFrame) -> DataFrame:
    """lang, term, in_lang (occurrences), docs (documents with the term) and sources: each source's occurrences. Tasks add up
    what they read and pass it on when they hold MOST_HELD sums; then all sums of a term meet, one row for each source."""
    small_batches(texts.sparkSession)
    partial = texts.select("lang", "text", "copies").mapInArrow(trimmed(_tallied), "lang string, source string, term string, count long, docs long")
    sums = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    return sums.groupBy("lang", "term").agg(F.sum("count").alias("in_lang"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "count")).alias("sources"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * kept)), in whole numbers of any size; null without kept terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    scaled = (whole(count) + F.lit(ADDED)) * F.lit(SCALE).cast("decimal(11,0)")
    divisor = whole(total) + whole(kept) * F.lit(ADDED)
    return F.when(kept > 0, F.call_function("div", scaled, divisor) + 1)


class Shares:
    """The stored tables of one audit: `groups` (lang, source, total, kept, least), `langs` the same for whole languages, and
    `terms` (lang, source, term, p, q): kept terms that a group has, with the group's and the language's shares."""

    def __init__(self, docs: DataFrame, least: int = LEAST):
        texts = collapsed(docs)
        kept = term_counts(texts).filter(F.col("docs") >= least)
        own = written(kept.select("lang", "term", "in_lang", F.inline("sources")), "kept-counts")
        vocabulary = own.groupBy("lang", "term").agg(F.first("in_lang").alias("in_lang")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("total"))
        every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
        totals = own.groupBy("lang", "source").agg(F.sum("count").alias("total"))
        langs = every.select("lang").distinct().join(vocabulary, "lang", "left").fillna(0, ["kept", "total"])
        groups = every.join(langs.select("lang", "kept", F.col("total").alias("lang_total")), "lang").join(totals, ["lang", "source"], "left").fillna(0, ["total"])
        self.langs = langs
        self.groups = written(groups.withColumn("least", share(F.lit(0), F.col("total"), F.col("kept"))), "groups")
        p = share(F.col("count"), F.col("total"), F.col("kept"))
        q = share(F.col("in_lang"), F.col("lang_total"), F.col("kept"))
        self.terms = written(own.join(self.groups.drop("least"), ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q")), "term-shares")

    def pairs(self) -> DataFrame:
        """lang, source, item (another source of the language) and value: the sum of |p - q| over all kept terms."""
        named = lambda df, k: df.select("lang", *[F.col(c).alias(f"{c}{k}") for c in df.columns if c != "lang"])
        groups = self.groups.select("lang", "source", "kept", "least")
        both = named(groups, 1).join(named(groups.drop("kept"), 2), "lang").filter("source1 < source2")
        gap = F.abs(F.col("least1") - F.col("least2"))
        base = both.select("lang", "source1", "source2", F.when(F.col("kept1") > 0, F.col("kept1") * gap).otherwise(0).alias("value"))
        # a source's own terms against another's share of no occurrence: by distinct share of it, as many terms have the same
        spread = self.terms.groupBy("lang", F.col("source").alias("source1"), F.col("p").alias("p1")).agg(F.count("*").alias("n1"))
        others = both.select("lang", F.inline(F.array(F.struct("source1", "least1", "source2", "least2"), F.struct(F.col("source2").alias("source1"), F.col("least2").alias("least1"), F.col("source1").alias("source2"), F.col("least1").alias("least2")))))
        own = spread.join(others, ["lang", "source1"])
        alone = own.groupBy("lang", F.least("source1", "source2").alias("source1"), F.greatest("source1", "source2").alias("source2")).agg(
            F.sum(F.col("n1") * (F.abs(F.col("p1") - F.col("least2")) - gap)).alias("value")
        )
        terms = self.terms.select("lang", "source", "term", "p").join(groups.drop("kept"), ["lang", "source"])
        shared = terms.select("lang", "term", *[F.col(c).alias(f"{c}1") for c in ("source", "p", "least")]).join(terms.select("lang", "term", *[F.col(c).alias(f"{c}2") for c in ("source", "p", "least")]), ["lang", "term"]).filter("source1 < source2")
        excess = F.abs(F.col("p1") - F.col("p2")) - F.abs(F.col("p1") - F.col("least2")) - F.abs(F.col("least1") - F.col("p2")) + gap
        met = shared.groupBy("lang", "source1", "source2").agg(F.sum(excess).alias("value"))
        summed = base.unionByName(alone).unionByName(met).groupBy("lang", "source1", "source2").agg(F.sum("value").alias("value"))
        sides = F.array(F.struct(F.col("source1").alias("source"), F.col("source2").alias("item")), F.struct(F.col("source2").alias("source"), F.col("source1").alias("item")))
        return summed.select("lang", F.explode(sides).alias("side"), "value").select("lang", "side.source", "side.item", "value")

    def marked(self) -> DataFrame:
        """lang, source, item (a term that the group has more of than its language) and value."""
        return self.terms.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank: every pair of sources of a language, and each group's `top`
    terms that it has more of than its language."""
    shares = Shares(docs, least)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = shares.pairs().withColumn("rank", place).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    terms = shares.marked().withColumn("rank", place).filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


def contract(docs: DataFrame) -> DataFrame:
    """The columns of op12."""
    return audit(docs)


ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST}),
size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
parts AS (SELECT DISTINCT lang, source FROM docs),
own AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
total AS (SELECT lang, source, sum(n) AS n FROM own GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(o.n, 0) + {ADDED})) // (coalesce(t.n, 0) + {ADDED} * s.v) AS p, 1 + ({SCALE}::HUGEINT * (k.n + {ADDED})) // (s.n + {ADDED} * s.v) AS q
  FROM parts g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term LEFT JOIN total t ON t.lang = g.lang AND t.source = g.source),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(d.value, 0) AS BIGINT) AS value FROM parts a JOIN parts b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS one, y.source AS two, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) d ON d.lang = a.lang AND d.one = a.source AND d.two = b.source)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT), CAST(row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS INT) AS place FROM p WHERE n > 0 AND p > q QUALIFY place <= {TOP}"""

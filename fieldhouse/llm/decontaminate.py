"""Benchmark decontamination: a broadcast set of normalised benchmark n-grams, scanned over document word windows.

Words are maximal runs of letters and digits of ASCII and of all bytes above it, after A-Z are lower-cased. An item's
windows are its runs of N words, or all its words if it has fewer. The windows go to the executors as sorted 64-bit
hashes with the items' word codes, and each hash hit is verified word by word. What is broadcast is bounded: the benchmark is
split into blocks of at most `block_bytes` of text, and each block is a scan of its own whose hits are merged by row, so
a benchmark of any size works (one block, no shuffle, in the usual case). With more blocks the ids and texts are written
once with a number for each row, and only numbers, counts and hits are shuffled.

Null or empty texts have no words and no hits; items without words have no windows; repeated documents are judged each on
its own; extra columns are ignored by `find` and kept by `decontaminate`. Items with a null id count like others: their words are
hits, and together they are one null in item_ids, counted in n_items and left out of the digest of the ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhouse.llm.util import WordCodes, byte_values, chunks, ids_and_texts, small_batches, written

N = 10
BLOCK_BYTES = 8_000_000
FOUND = "doc_id long, n_words long, hits array<struct<start:int,end:int>>, item_ids array<long>"


def _normaliser() -> bytes:
    """A byte table: A-Z to a-z, other ASCII outside 0-9 and a-z to a space, bytes above ASCII unchanged."""
    lower = bytes(range(256)).lower()
    return bytes(x if 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or x >= 0x80 else 0x20 for x in lower)


NORMALISE = _normaliser()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMALISE).split()


class WindowIndex:
    """The windows of some benchmark items, by length: sorted 64-bit hashes, and for each the place of its words' codes. A word
    of an item takes about 40 bytes, so a block of items takes some three times the bytes of its text."""

    def __init__(self, items: list[tuple[int, str | None]], n: int = N):
        codes = WordCodes(1 << 60)
        lists = [words_of((text or "").encode()) for _, text in items]
        sizes = np.array([len(w) for w in lists], np.int64)
        starts = np.cumsum(sizes) - sizes
        self.words = np.fromiter((codes[w] for words in lists for w in words), np.uint64, int(sizes.sum()))
        self.code = dict(codes)
        self.ids = [i for i, _ in items]
        #: length -> hashes, places of the windows in words, their items' numbers
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(np.minimum(sizes[sizes > 0], n)).tolist():
            own = np.flatnonzero(np.minimum(sizes, n) == size)
            count = sizes[own] - size + 1
            item = np.repeat(own, count)
            at = np.repeat(starts[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            hashes = _hashed(self.words, at, size)
            order = np.argsort(hashes, kind="stable")
            self.by_length[size] = hashes[order], at[order], item[order].astype(np.int32)

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], list[int]]]:
        """For each text: its number of words, the word ranges hit (merged), and the items hit."""
        get = self.code.get
        lists = [words_of(t) for t in texts]
        sizes = np.array([len(x) for x in lists], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # one word that no window has stands between two texts
        codes = np.zeros(int(starts[-1]) + 1, np.uint64)
        for at, words in zip(starts, lists):
            codes[at : at + len(words)] = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        unknown = np.concatenate([[0], np.cumsum(codes == 0)])
        edges = np.zeros(len(codes) + 1, np.int64)
        items: dict[int, set[int]] = {}
        for size, (hashes, place, owner) in self.by_length.items():
            if len(codes) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            key = _hashed(codes, at, size)
            left, right = np.searchsorted(hashes, key, "left"), np.searchsorted(hashes, key, "right")
            step = 0
            while (more := left + step < right).any():  # windows of equal hash: in practice those that several items share
                at_, row = at[more], left[more] + step
                same = (codes[at_[:, None] + np.arange(size)] == self.words[place[row][:, None] + np.arange(size)]).all(axis=1)
                at_, row = at_[same], row[same]
                np.add.at(edges, at_, 1)
                np.add.at(edges, at_ + size, -1)
                doc = np.searchsorted(starts, at_, "right") - 1
                for d, k in np.unique(np.stack([doc, owner[row]], axis=1), axis=0).tolist():
                    items.setdefault(d, set()).add(self.ids[k])
                step += 1
        hit = np.cumsum(edges) > 0
        turns = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        begins, ends = turns[::2], turns[1::2]
        first = np.searchsorted(begins, starts)
        for d, n in enumerate(sizes.tolist()):
            base = int(starts[d])
            spans = [(int(b) - base, int(e) - base) for b, e in zip(begins[first[d] : first[d + 1]], ends[first[d] : first[d + 1]])]
            yield n, spans, sorted(items.get(d, ()), key=_place)


def _place(item_id: int | None) -> tuple[bool, int]:
    """The order of item ids, null last."""
    return item_id is None, item_id or 0


def _hashed(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (codes[at + j] ^ (codes[at + j] >> np.uint64(29)))
    return out ^ (out >> np.uint64(32))


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items in blocks of about block_bytes of text, by a hash of the item; a single block if all fit."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    n = 1 + 2 * (size // block_bytes) if size > block_bytes else 1
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [items]


def _index(block: DataFrame, n: int):
    rows = [(r["item_id"], r["text"]) for r in block.collect()]
    return block.sparkSession.sparkContext.broadcast(WindowIndex(rows, n))


def find(docs: DataFrame, benchmark: DataFrame, n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: number of words, merged word ranges hit by benchmark windows, ids of the items that occur."""
    source, blocks = ids_and_texts(docs), _blocks(benchmark, block_bytes)
    if len(blocks) == 1:
        return source.mapInArrow(_scan(_index(blocks[0], n), True), FOUND)
    numbered = written(source.withColumn("row", F.monotonically_increasing_id()), "scanned")
    parts = [numbered.mapInArrow(_scan(_index(block, n), k == 0), f"{FOUND}, row long") for k, block in enumerate(blocks)]
    return _merged(parts).drop("row")


def _scan(index, every: bool):
    """The scan over batches of doc_id, text and further columns, which are kept; rows without hits only if `every`."""

    def scan(batches):
        for batch in batches:
            texts = byte_values(batch.column(1))
            for part in chunks(texts):
                found = [(i, x) for i, x in zip(range(part.start, part.stop), index.value.scan(texts[part])) if every or x[1]]
                rows = batch.take(pa.array([i for i, _ in found], pa.int64()))
                columns = [
                    rows.column(0),
                    pa.array([w for _, (w, _, _) in found], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in spans] for _, (_, spans, _) in found], pa.list_(_SPAN)),
                    pa.array([items for _, (_, _, items) in found], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([*columns, *rows.columns[2:]], names=["doc_id", "n_words", "hits", "item_ids", *batch.schema.names[2:]])

    return scan


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def _merged(parts: list[DataFrame]) -> DataFrame:
    """The blocks' findings put together by row number; ranges that touch or overlap become one."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("hits"))),
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    found = every.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), merged.alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids")
    )
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without contaminated documents (mode "document") or without the hit words (mode "span"); same columns.

    In span mode the text from a hit range's first word to its last is cut out. Hits are judged on the texts as they came,
    whatever the number of blocks: with several, numbered documents are stored, and all blocks' ranges meet them by number."""
    small_batches(docs.sparkSession)
    schema, blocks = docs.schema, _blocks(benchmark, block_bytes)
    at = schema.fieldNames().index("text")

    def shortened(batch: pa.RecordBatch, texts: list[bytes], spans: list) -> pa.RecordBatch:
        old = batch.column(at)
        new = [cut(t, s).decode() if s else v.as_py() for t, v, s in zip(texts, old, spans)]
        return pa.RecordBatch.from_arrays([pa.array(new, old.type) if i == at else batch.column(i) for i in range(len(schema))], names=[f"c{i}" for i in range(len(schema))])

    renamed = docs.toDF(*[f"c{i}" for i in range(len(schema))])
    if mode == "document" or len(blocks) == 1:
        out = renamed
        for block in blocks:
            index = _index(block, n)

            def clean(batches, index=index):
                for batch in batches:
                    texts = byte_values(batch.column(at))
                    found = [x for part in chunks(texts) for x in index.value.scan(texts[part])]
                    if mode == "document":
                        yield batch.filter(pa.array([not spans for _, spans, _ in found], pa.bool_()))
                    else:
                        yield shortened(batch, texts, [spans for _, spans, _ in found])

            out = out.mapInArrow(clean, renamed.schema)
        return out.toDF(*schema.fieldNames())

    numbered = written(renamed.withColumn("row", F.monotonically_increasing_id()), "numbered")
    source = numbered.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"c{at}").cast("string").alias("text"), "row")
    parts = [source.mapInArrow(_scan(_index(block, n), False), f"{FOUND}, row long") for block in blocks]
    joined = numbered.join(_merged(parts).select("row", "hits"), "row", "left").select(*renamed.columns, "hits")

    def cut_out(batches):
        for batch in batches:
            spans = [[(h["start"], h["end"]) for h in x] if x else [] for x in batch.column(len(schema)).to_pylist()]
            yield shortened(batch, byte_values(batch.column(at)), spans)

    return joined.mapInArrow(cut_out, renamed.schema).toDF(*schema.fieldNames())


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the bytes from the first to the last word of each word range."""
    import re

    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(NORMALISE))]
    out, done = [], 0
    for start, end in spans:
        out.append(text[done : places[start][0]])
        done = places[end - 1][1]
    return b"".join([*out, text[done:]])


def contract(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The digest columns of op10, from `find`."""
    found = find(docs, benchmark, block_bytes=block_bytes)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]))
    names = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bwin AS (SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0) x),
ls AS (SELECT DISTINCT l FROM bwin),
dwin AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS win FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, ls WHERE len(w) >= l) x),
hit AS (SELECT doc_id, i, l, item_id FROM dwin JOIN bwin USING (l, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) x GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) x GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos ON pos.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
"""

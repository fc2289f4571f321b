"""Suffix-array deduplication: every byte covered by a LENGTH-byte string that also starts earlier is removed.

Sorting all suffixes of a corpus at once would move each byte a hundred times, so suffixes are sorted blockwise, and only
where sorting decides something:

1. Each text is cut into runs of strings that share an anchor, a gram chosen by the string's own bytes (see Segmenter).
   Equal strings have equal anchors, so only strings of one anchor need comparing. A run is a row: anchor hash, digest of
   the run's bytes, document and place. Runs with equal bytes in one Arrow batch are told apart there; only the first
   goes to its anchor's partition, so an anchor in a third of all texts sends a row or so for each batch.
2. A window over each anchor: of runs with equal bytes all but the first are repeats as a whole. An anchor whose runs are
   all alike is settled. Only the first runs of anchors with different runs are still open.
3. The open runs' bytes are cut from the texts and brought together by anchor; blocks of them of bounded size are
   suffix-sorted with a difference cover (see BlockSuffixes), which compares the strings exactly. Anchors with more than
   `most_runs` different runs are not gathered: their strings travel one by one under a 128-bit digest, and of equal
   ones all but the first are repeats.
4. The texts meet their repeats by document id and are cut.

Texts are shuffled once: both uses of the joined table read one exchange. Earlier means smaller doc_id, then earlier start.
Null text is empty; null doc_id counts as the smallest id. Texts under LENGTH bytes lose nothing. A row written twice
(same id, same text) is one document: neither copy counts as earlier. Different texts of one id are documents of their
own, in the order of a digest of the text.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldhouse.llm.substrings import LENGTH, Segmenter, repeated_starts
from fieldhouse.llm.util import byte_values, chunks, mixed, small_batches, trimmed, written

#: Bytes of open runs that are suffix-sorted together; different runs of an anchor up to which they are.
BLOCK_BYTES, MOST_RUNS = 800_000, 5_000
REPEAT, OPEN, CROWDED = 0, 1, 2
_NONE = -(1 << 63)
_i64 = lambda x: np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def _key() -> F.Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE))


def _first_of_batch(h: np.ndarray, s: np.ndarray, k: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows with, for all but the first of equal (h, s), a key of their own and the mark `settled`."""
    order = np.lexsort((place, k, s, h))
    h, s, k, place = h[order], s[order], k[order], place[order]
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (s[1:] == s[:-1])])
    leader = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    later = same & ((k != k[leader]) | (place != place[leader]))
    own = mixed(k.view(np.uint64) * np.uint64(3) + mixed(place.view(np.uint64)))
    return np.where(later, own, h), s, k, place, later


RUNS = "h long, s long, k long, place long, settled boolean"


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """Step 1, over (k, text). place: start of the run's first string times 256, plus the number of its strings."""

    def run(batches):
        cut = Segmenter(length)
        for batch in batches:
            texts, ids = byte_values(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            found = []
            for part in chunks(texts):
                doc, start, count, h, s = cut(texts[part])
                found.append((h, s, ids[part][doc].astype(np.int64), start * 256 + count))
            if found:
                columns = _first_of_batch(*(np.concatenate(x) for x in zip(*found)))
                yield pa.RecordBatch.from_arrays([pa.array(_i64(x)) for x in columns[:4]] + [pa.array(columns[4])], names=["h", "s", "k", "place", "settled"])

    return docs.mapInArrow(trimmed(run), RUNS)


def _judged(runs: DataFrame, most_runs: int) -> DataFrame:
    """Step 2: (k, kind, place, h) of repeats and of open runs."""
    same, anchor = Window.partitionBy("h", "s").orderBy("k", "place"), Window.partitionBy("h")
    # one exchange by anchor serves both windows
    marked = runs.repartition("h").withColumn("earlier", F.rank().over(same) > 1)  # rank: rows written twice tie
    marked = marked.withColumns({"least": F.min("s").over(anchor), "most": F.max("s").over(anchor), "firsts": F.count(F.when(~F.col("earlier"), 1)).over(anchor)})
    kind = (
        F.when(F.col("settled") | F.col("earlier"), REPEAT)
        .when(F.col("least") == F.col("most"), None)
        .otherwise(F.when(F.col("firsts") > most_runs, CROWDED).otherwise(OPEN))
    )
    return marked.select("k", kind.alias("kind"), "place", F.when(kind == REPEAT, F.lit(0).cast("long")).otherwise(F.col("h")).alias("h")).filter("kind is not null")


OPENED = "h long, s long, k long, place long, body binary"


def _opened(joined: DataFrame, text_at: int, length: int) -> DataFrame:
    """Step 3, first half: the bytes of open runs, and the strings of crowded anchors under their digests."""
    schema = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("k", pa.int64()), ("place", pa.int64()), ("body", pa.binary())])

    def run(batches):
        cut = Segmenter(length)
        for batch in batches:
            rows = batch.column(batch.num_columns - 1)
            flat, offsets = rows.flatten(), rows.offsets.to_numpy()
            offsets = offsets - offsets[0]
            kind, place, h = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            doc = np.repeat(np.arange(len(rows)), np.diff(offsets)) if len(rows) else np.zeros(0, np.int64)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            todo = np.flatnonzero(kind != REPEAT)
            if not len(todo):
                continue
            need = np.unique(doc[todo])
            texts = dict(zip(need.tolist(), byte_values(batch.column(text_at).take(pa.array(need)))))
            out_h, out_s, out_k, out_place, body = [], [], [], [], []
            crowded = []
            for i in todo.tolist():
                d, start, count = int(doc[i]), int(place[i]) >> 8, int(place[i]) & 255
                data = texts[d][start : start + count + length - 1]
                if kind[i] == OPEN:
                    out_h.append(h[i])
                    out_k.append(ids[d])
                    out_place.append(place[i])
                    body.append(data)
                else:
                    crowded.append((data, int(ids[d]), start, count))
            if body:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((out_h, [0] * len(body), out_k, out_place, body), (f.type for f in schema))], schema=schema)
            if crowded:
                columns = _first_of_batch(*_strings(cut, crowded, length))
                # rows settled here carry a count of 0, and a key of their own
                marked = np.where(columns[4], columns[3] - 1, columns[3])
                arrays = [pa.array(_i64(x)) for x in (columns[0], columns[1], columns[2], marked)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(marked), pa.binary())], schema=schema)

    return joined.mapInArrow(trimmed(run), OPENED)


def _strings(cut: Segmenter, crowded: list, length: int) -> tuple[np.ndarray, ...]:
    """Two 64-bit digests, document key and place of every string of some runs."""
    data = b"".join([x[0] for x in crowded])
    n = len(data)
    sizes, counts = np.array([len(x[0]) for x in crowded]), np.array([x[3] for x in crowded])
    base = np.cumsum(sizes) - sizes
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(base, counts) + inner
    padded = data + bytes(8)
    one = cut.digests(padded, n, at, at + length)
    two = cut.digests(padded, n, at, at + length // 2) * np.uint64(0x9E3779B97F4A7C15) + mixed(cut.digests(padded, n, at + length // 2, at + length))
    k = np.repeat(np.array([x[1] for x in crowded], np.int64), counts)
    start = np.repeat(np.array([x[2] for x in crowded], np.int64), counts) + inner
    return one, two, k, start * 256 + 1


def _resolved(opened: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """Step 3, second half: (k, place) of repeats among the open runs. Rows come sorted by anchor and are handled in
    blocks of whole anchors."""
    ordered = opened.repartition("h").sortWithinPartitions("h", "s", "k", "place")

    def repeats(h, k, place, body):
        text = b"".join(body)
        counts, sizes = place & 255, np.array([len(x) for x in body])
        base = np.cumsum(sizes) - sizes
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        row = np.repeat(np.arange(len(body)), counts)
        start = (place >> 8)[row] + inner
        hit = np.flatnonzero(repeated_starts(text, base[row] + inner, k[row], start, length))
        # strings next to each other become one run again
        new = np.concatenate([[True], (row[hit][1:] != row[hit][:-1]) | (start[hit][1:] != start[hit][:-1] + 1)])[: len(hit)]
        first = np.flatnonzero(new)
        return k[row[hit[first]]], start[hit[first]] * 256 + np.diff(np.append(first, len(hit)))

    def run(batches):
        waiting: list = []
        size, last = 0, None  # last: (h, s, k, place) of the string before, among those under digests

        def flush(parts):
            h, k, place = (np.concatenate([p[i] for p in parts]) for i in range(3))
            return repeats(h, k, place, [x for p in parts for x in p[3]])

        def out(k, place):
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(place, pa.int64())], names=["k", "place"])

        for batch in batches:
            h, s, k, place = (batch.column(i).to_numpy() for i in range(4))
            bodies = batch.column(4)
            whole = bodies.is_valid().to_numpy(zero_copy_only=False)
            single = np.flatnonzero(~whole)
            if len(single):
                a, b, c, p = h[single], s[single], k[single], place[single]
                settled = (p & 255) == 0
                same = np.concatenate([[last is not None and (a[0], b[0]) == last[:2]], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
                leader = np.maximum.accumulate(np.where(same, -1, np.arange(len(a))))
                lead_k = np.where(leader < 0, last[2] if last else 0, c[np.maximum(leader, 0)])
                lead_p = np.where(leader < 0, last[3] if last else 0, p[np.maximum(leader, 0)])
                later = settled | (same & ((c != lead_k) | (p != lead_p)))
                last = (a[-1], b[-1], lead_k[-1], lead_p[-1])
                if later.any():
                    yield out(c[later], (p[later] >> 8) * 256 + 1)
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            h, k, place, values = h[at], k[at], place[at], bodies.take(pa.array(at)).to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(h)) + 1).tolist(), len(h)]
            for a, b in zip(cuts, cuts[1:]):
                if waiting and size > block_bytes and waiting[-1][0][-1] != h[a]:
                    yield out(*flush(waiting))
                    waiting, size = [], 0
                waiting.append((h[a:b], k[a:b], place[a:b], values[a:b]))
                size += sum(map(len, values[a:b]))
        if waiting:
            yield out(*flush(waiting))

    return ordered.mapInArrow(trimmed(run), "k long, place long")


def _told_apart(texts: DataFrame, text: str) -> DataFrame:
    """texts with a key k of one text each. Ids usually are; where an id stands for several texts, all keys become places
    in the order of id, then text digest. The mapping is stored, so that later reads see the same places."""
    digest = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = texts.select("k", digest.alias("digest"))
    if rows.groupBy("k").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").isEmpty():
        return texts
    order = written(rows.distinct().sort("k", "digest").withColumn("place", F.monotonically_increasing_id()), "keys")
    joined = texts.withColumn("digest", digest).join(order, ["k", "digest"])
    return joined.select(F.col("place").alias("k"), *texts.columns[1:])


def _cuts(docs: DataFrame, names: list[str], length: int, most_runs: int, block_bytes: int) -> DataFrame:
    """docs as columns k, then the columns of `names` renamed c0, c1, ..., then the places of its repeats (two arrays)."""
    small_batches(docs.sparkSession)
    text = f"c{names.index('text')}"
    texts = _told_apart(docs.select(_key().alias("k"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))), text)
    judged = _judged(_runs(texts.select("k", F.col(text).cast("string").alias("text")), length), most_runs)
    found = judged.groupBy("k").agg(F.collect_list(F.struct("kind", "place", "h")).alias("rows"))
    joined = texts.join(found, "k", "left")
    empty = F.expr("cast(array() as array<struct<kind:int,place:bigint,h:bigint>>)")
    opened = _opened(joined.select("k", *(f"c{i}" for i in range(len(names))), F.coalesce("rows", empty).alias("rows")), 1 + names.index("text"), length)
    more = _resolved(opened, length, block_bytes).groupBy("k").agg(F.collect_list("place").alias("more"))
    settled = F.transform(F.filter(F.coalesce("rows", empty), lambda r: r["kind"] == REPEAT), lambda r: r["place"])
    return joined.join(more, "k", "left").select(
        "k", *(f"c{i}" for i in range(len(names))), F.concat(settled, F.coalesce("more", F.expr("cast(array() as array<bigint>)"))).alias("places")
    )


def removed_ranges(size: int, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal removed byte ranges."""
    begin = places >> 8
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.minimum(begin + (places & 255) + length - 1, size)[order]
    if not len(begin):
        return begin, end
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return begin[first], reach[np.append(first[1:] - 1, len(reach) - 1)]


def _kept(text: bytes, places: np.ndarray, length: int) -> tuple[bytes, int, int]:
    begins, ends = removed_ranges(len(text), places, length)
    out, done = [], 0
    for a, b in zip(begins.tolist(), ends.tolist()):
        out.append(text[done:a])
        done = b
    return b"".join([*out, text[done:]]), int((ends - begins).sum()), len(begins)


def _places(column: pa.ListArray):
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def contract(docs: DataFrame, length: int = LENGTH, most_runs: int = MOST_RUNS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of op6."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            texts = byte_values(batch.column(2))
            found = [_kept(t, p, length) for t, p in zip(texts, _places(batch.column(3)))]
            columns = [batch.column(1), [len(t) for t in texts], [f[1] for f in found], [f[2] for f in found], [sha256(f[0]).hexdigest() for f in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _cuts(own, ["doc_id", "text"], length, most_runs, block_bytes).mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, length: int = LENGTH, most_runs: int = MOST_RUNS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the repeated bytes cut out of their texts; same columns. Bytes of a character that a cut goes through are
    dropped, so texts stay valid. n_chars, where there is one, is the new number of characters."""
    names, schema = docs.columns, docs.schema
    text_at = 1 + names.index("text")
    chars_at = 1 + names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            texts, old = byte_values(batch.column(text_at)), batch.column(text_at)
            new = [_kept(t, p, length)[0].decode(errors="ignore") if len(p) else v.as_py() for t, v, p in zip(texts, old, _places(batch.column(batch.num_columns - 1)))]
            columns = [batch.column(i) for i in range(1, batch.num_columns - 1)]
            columns[text_at - 1] = pa.array(new, old.type)
            if chars_at is not None:
                counts = batch.column(chars_at)
                columns[chars_at - 1] = pa.array([c.as_py() if t is None else len(t) for t, c in zip(new, counts)], counts.type)
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    renamed = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return _cuts(docs, names, length, most_runs, block_bytes).mapInArrow(trimmed(run), renamed).toDF(*names)


ORACLE_SQL = """
WITH h AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
b AS (SELECT doc_id, n, CAST(i AS INT) AS i, substr(h, 2 * i + 1, 2) AS x, CASE WHEN i + 100 <= n THEN md5_number(substr(h, 2 * i + 1, 200)) END AS m FROM (SELECT *, unnest(range(0, n)) AS i FROM h) y),
d AS (SELECT doc_id, i, x, m IS NOT NULL AND row_number() OVER (PARTITION BY m ORDER BY doc_id, i) > 1 AS again FROM b),
c AS (SELECT doc_id, i, x, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM d),
f AS (SELECT doc_id, i, x, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept FROM f GROUP BY doc_id)
SELECT h.doc_id, h.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN g ON g.doc_id = h.doc_id
"""

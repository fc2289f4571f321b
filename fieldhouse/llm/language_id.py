"""Language identification: averaged hashed subword embeddings with a linear softmax, fitted by gradient descent in numpy.

A text is lower-cased; its features are the 1- to 4-byte substrings of its letters (other characters become one space),
hashed to BUCKETS. The document vector is the mean of its features' embeddings; a linear layer and a softmax give the
languages' probabilities. Labels are counted over all rows, and every language is learned. The model is fitted on a bounded
sample of the labelled documents (`most_rows`, and at least `least_rows` of each language, so `least_rows` times the
number of languages where that is more; drawn by a hash, whole texts); their features are counted on the executors. A fifth of the sample is kept back to calibrate:
the temperature that minimises its log loss scales the scores, and the score below which a prediction is `rejected` is
the least that still gives the wanted precision there.

Scoring multiplies embeddings and linear layer into one small table first, so a text costs one table lookup per feature.
Null texts and texts without a letter are `und` with score 0 and rejected. Rows with equal texts are scored alike. With
no labelled row at all everything is `und`. Input columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhouse.llm.util import chunks, small_batches

BUCKETS, DIMENSION, SIZES = 1 << 14, 16, (1, 2, 3, 4)
MOST_ROWS, LEAST_ROWS, EPOCHS, LEAST_STEPS, RATE, BATCH, PRECISION = 3000, 60, 12, 500, 2.0, 64, 0.98
_OTHER = re.compile(r"[\W\d_]+")


def _letters(text: str | None) -> bytes:
    """The text's words of letters, in small letters, with a blank at each end; only blanks if it has no letter (numerals
    like a half or a superscript two are word characters, but no letters)."""
    words = _OTHER.sub(" ", text.lower()).strip() if text else ""
    return (" " + words + " ").encode() if any(map(str.isalpha, words)) else b"  "


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts and the text each belongs to; no feature crosses two texts."""
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    key = np.zeros(len(data), np.uint32)
    found, owners = [], []
    for n in range(1, max(SIZES) + 1):
        if len(data) < n:
            break
        key = key[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(n)
        if n in SIZES:
            own = owner[: len(key)]
            inside = own == owner[n - 1 :]
            hashed = key * np.uint32(0x9E3779B1)
            found.append((hashed >> np.uint32(32 - (BUCKETS - 1).bit_length()))[inside])
            owners.append(own[inside])
    return (np.concatenate(found), np.concatenate(owners)) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int32))


def _sampled(labelled: DataFrame, most_rows: int, least_rows: int) -> list:
    """Feature counts of about most_rows labelled documents, drawn by a hash in each language: its share of them, or
    least_rows where that is more (all of its documents if it has fewer)."""
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()  # a row for each language
    if not sizes:
        return []
    total = sum(r["n"] for r in sizes)
    share = [v for r in sizes for v in (F.lit(r["lang"]), F.lit(int(1_000_000 * min(1.0, max(most_rows / total, least_rows / r["n"])))))]
    part = labelled.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.coalesce(F.try_element_at(F.create_map(*share), "lang"), F.lit(0)))

    def run(batches):
        for batch in batches:
            ids, labels, texts = (batch.column(k).to_pylist() for k in range(3))
            for i, label, text in zip(ids, labels, texts):
                counts = np.bincount(features([_letters(text)])[0], minlength=BUCKETS)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pylist(
                    [{"doc_id": i, "lang": label, "at": at.astype(np.uint16).tobytes(), "n": counts[at].astype(np.int32).tobytes()}],
                    schema=pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("n", pa.binary())]),
                )

    rows = part.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, at binary, n binary").collect()
    return sorted(rows, key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["lang"], bytes(r["at"])))


class Model:
    """languages, a BUCKETS x languages table of scores, a temperature and the rejection score."""

    def __init__(self, languages: list[str], scores: np.ndarray, bias: np.ndarray, temperature: float = 1.0, reject: float = 0.0):
        self.languages, self.scores, self.bias, self.temperature, self.reject = languages, scores, bias, temperature, reject

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        for part in chunks(texts, 500_000):
            own = texts[part]
            at, owner = features(own)
            counts = np.maximum(np.bincount(owner, minlength=len(own)), 1)
            for k in range(len(self.languages)):
                out[part, k] = np.bincount(owner, self.scores[at, k], minlength=len(own)) / counts
        return softmax((out + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(labelled: DataFrame, most_rows: int = MOST_ROWS, seed: int = 7, least_rows: int = LEAST_ROWS) -> Model | None:
    """A model of the labelled documents (doc_id, text, lang not null); None if there are none."""
    rows = _sampled(labelled, most_rows, least_rows)
    rows = [r for r in rows if len(r["at"])]
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    label = np.array([languages.index(r["lang"]) for r in rows])
    bags = [(np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["n"], np.int32).astype(np.float32)) for r in rows]
    bags = [(at, n / n.sum()) for at, n in bags]
    draw = np.random.default_rng(seed)
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    train = np.flatnonzero(~held)
    table = draw.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    layer, bias = np.zeros((DIMENSION, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(train)))  # a small sample is gone through more often
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        draw.shuffle(train)
        for start in range(0, len(train), BATCH):
            own = train[start : start + BATCH]
            hidden = np.stack([n @ table[at] for at, n in (bags[i] for i in own)])
            error = softmax(hidden @ layer + bias)
            error[np.arange(len(own)), label[own]] -= 1
            error /= len(own)
            back = error @ layer.T
            layer -= rate * 10 * hidden.T @ error
            bias -= rate * error.sum(axis=0)
            for row, i in zip(back, own):
                at, n = bags[i]
                table[at] -= rate * 10 * n[:, None] * row
    model = Model(languages, (table @ layer).astype(np.float32), bias.astype(np.float64))
    judged = np.flatnonzero(held) if held.any() else train
    raw = np.stack([n @ model.scores[at] for at, n in (bags[i] for i in judged)]) + bias
    right = label[judged]
    grid = np.geomspace(0.02, 5, 60)
    model.temperature = float(min(grid, key=lambda t: -np.log(softmax(raw / t)[np.arange(len(right)), right] + 1e-12).mean()))
    scores = softmax(raw / model.temperature)
    order = np.argsort(-scores.max(axis=1), kind="stable")
    precision = np.cumsum(scores.argmax(axis=1)[order] == right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= PRECISION)
    model.reject = float(scores.max(axis=1)[order[good[-1]]]) if len(good) else 1.0
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected (score below the calibrated one, or no letter)."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = known.value
        for batch in batches:
            texts = [_letters(t) for t in batch.column(1).to_pylist()]
            none = np.array([own is None or not t.strip() for t in texts], bool)
            if own is None or none.all():
                best, score = ["und"] * len(texts), np.zeros(len(texts))
            else:
                p = own.probabilities(texts)
                best = [own.languages[k] for k in p.argmax(axis=1)]
                best, score = ["und" if x else b for x, b in zip(none, best)], np.where(none, 0.0, p.max(axis=1))
            rejected = none | (score < (own.reject if own else 1.0))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((batch.column(0), best, score, rejected), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out() -> F.Column:
    """Documents that nothing is learned from. A null id counts as an empty one."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def contract(docs: DataFrame) -> DataFrame:
    """The columns of op9: learn from labelled documents that are not held out, predict all."""
    model = fit(docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")

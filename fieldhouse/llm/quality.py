"""Quality rules with robust multivariate outliers: minimum covariance determinant per language and source.

`statistics` counts words, symbols, repeated lines and repeated word windows of whole texts. `estimates` looks, for each
(lang, source), for the H fraction of documents whose covariance has the least determinant: it starts from three
deterministic estimates (medians and quartile ranges, mean and covariance, spatial signs about the medians), repeats
concentration steps from each, and takes the least determinant. A step is one distributed aggregation: squared distances
are counted, with the moments of the vectors, in geometric bins; the bins that hold the closest H of the group give the
next centre. So no group is ever gathered, whatever share of the rows it has, and the result does not depend on how rows are
dealt out. `judge` rejects documents whose squared Mahalanobis distance exceeds a cutoff.

Groups with fewer than `min_rows` documents take the estimates of their language, languages with fewer those of all
documents; where these too are few, no document is rejected by distance. Null lang or source is a group like another. Null
text has no words. Ties and repeated rows count as they stand. Columns of the input other than doc_id, text, lang and
source are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldhouse.llm.util import WordCodes, byte_values, chunks, mixed, small_batches, trimmed, written

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Share of a group that the estimates rest on; concentration steps; rows below which a group is small.
H, STEPS, MIN_ROWS = 0.75, 4, 40
#: The closest 3/4 of a normal sample of 5 dimensions spread less than all of it, by this factor: 0.75 over the share of a
#: chi-squared variable of 7 degrees below 6.63, the upper quartile of one of 5 degrees.
CONSISTENCY = 1.41
#: A document is rejected beyond this squared distance: of a normal sample of 5 dimensions, one in six million lies there.
CUTOFF = 40.0
#: The least standard deviation of each transformed statistic, about that of a text of 150 words by chance alone: statistics
#: that are nearly constant in a group (no symbols at all) would else reject the first text that has one.
FLOORS = (0.08, 0.07, 0.15, 0.2, 0.5)
#: Bins per e-fold of squared distance, and the range of exponents.
BINS, LOW, HIGH = 32, -10, 25
D = len(FLOORS)


def counted(texts: list[bytes], codes: WordCodes) -> np.ndarray:
    """A row of COUNTS for each text."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    lists = [t.split() for t in texts]  # of bytes: splits at \\x20 and \\x09-\\x0D only
    for i, (text, words) in enumerate(zip(texts, lists)):
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[i] = len(words), 0, sum(map(text.count, (SYMBOLS[k : k + 1] for k in range(len(SYMBOLS))))), len(lines) - len(set(lines)), 0
    data = np.frombuffer(b"".join(texts), np.uint8)
    # code points in words: neither continuation bytes nor white space
    points = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & (data != 0x20) & ((data < 9) | (data > 13)))])
    ends = np.cumsum([len(t) for t in texts])
    out[:, 1] = points[ends] - points[ends - [len(t) for t in texts]]
    out[:, 4] = repeated([codes.of(w) for w in lists])
    return out


def repeated(lists: list[np.ndarray]) -> np.ndarray:
    """For each list of word codes, the words in windows of WINDOW that occur twice or more in the list."""
    sizes = np.array([len(x) for x in lists], np.int64)
    if not sizes.sum():
        return np.zeros(len(lists), np.int64)
    codes, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), sizes)
    if len(codes) < WINDOW:
        return np.zeros(len(lists), np.int64)
    n = len(codes) - WINDOW + 1
    at = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    key = mixed(owner[at].astype(np.uint64) + np.uint64(1))
    for j in range(WINDOW):
        key = key * np.uint64(0x9E3779B97F4A7C15) + (codes[at + j] ^ (codes[at + j] >> np.uint64(31)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edges, at[twice], 1)
    np.add.at(edges, at[twice] + WINDOW, -1)
    return np.bincount(owner[np.cumsum(edges[:-1]) > 0], minlength=len(lists))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and COUNTS of every whole text."""
    small_batches(docs.sparkSession)
    source = docs.select(*(F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"))))

    def run(batches):
        codes = WordCodes()
        for batch in batches:
            texts = byte_values(batch.column(1))
            for part in chunks(texts):
                rows = counted(texts[part], codes)
                kept = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), kept.column(2), kept.column(3), *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], names=["doc_id", "lang", "source", *COUNTS]
                )

    return source.mapInArrow(trimmed(run), "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> F.Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vector() -> list[F.Column]:
    """The transformed statistics; square roots and logarithms bring counts and ratios nearer to a normal shape."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log((F.col("word_chars") + 1) / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") / words),
        F.sqrt(F.col("n_repeat_words") / words),
        F.log1p(words),
    ]


#: Marks of the groups that small groups fall back to.
_LANG, _ALL = "\x1elang", "\x1eall"


def _group_names() -> dict[str, F.Column]:
    lang, source = F.coalesce("lang", F.lit("\x00")), F.coalesce("source", F.lit("\x00"))
    return {"own": F.concat_ws("\x1f", lang, source), "of_lang": F.concat_ws("\x1f", F.lit(_LANG), lang)}


def _quadratic() -> F.Column:
    """(x - centre)' inverse (x - centre); the inverse is a flat array."""
    d = [F.col("x")[i] - F.col("centre")[i] for i in range(D)]
    return sum((d[i] * d[j] * F.col("inverse")[i * D + j] for i in range(D) for j in range(D)), F.lit(0.0))


def _fitted(centre: np.ndarray, cov: np.ndarray) -> tuple[list[float], list[float]]:
    cov = (cov + cov.T) / 2
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    wide = np.maximum(scale, FLOORS)
    cov = cov * np.outer(wide / scale, wide / scale) * (1 - 1e-6) + np.diag(wide**2) * 1e-6
    values, vectors = np.linalg.eigh(cov / np.outer(wide, wide))
    inverse = (vectors / np.maximum(values, 0.3)) @ vectors.T / np.outer(wide, wide)
    return centre.tolist(), inverse.reshape(-1).tolist()


FIT = "grp string, start int, centre array<double>, inverse array<double>, n long, det double"


def _concentrated(pdf):
    """The next estimates of one group and start from its bins (at most (HIGH - LOW) * BINS rows); det: the determinant of the
    covariance of the closest H."""
    import pandas as pd

    pdf = pdf.sort_values("bin")
    upto = np.cumsum(pdf["n"].to_numpy(float))
    k = int(np.searchsorted(upto, H * upto[-1])) + 1
    centre, cov = _moments(pdf[_MOMENTS].to_numpy()[:k].sum(axis=0), upto[k - 1])
    fitted = _fitted(centre, cov * CONSISTENCY)
    return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "start": [pdf["start"].iloc[0]], "centre": [fitted[0]], "inverse": [fitted[1]], "n": [int(upto[-1])], "det": [float(max(np.linalg.det(cov), 0.0))]})


_MOMENTS = [f"m{i}" for i in range(D + D * D)]


def _moments(sums: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    centre = sums[:D] / n
    return centre, sums[D:].reshape(D, D) / n - np.outer(centre, centre)


def _moment_sums(x: F.Column) -> list[F.Column]:
    return [F.sum(x[i]).alias(f"m{i}") for i in range(D)] + [F.sum(x[i] * x[j]).alias(f"m{D + i * D + j}") for i in range(D) for j in range(D)]


def _quartiles(pdf):
    """25, 50 and 75 percent of each statistic of one group, from counts in fine bins (their middles)."""
    import pandas as pd

    out = np.zeros((D, 3))
    for i in range(D):
        own = pdf[pdf["i"] == i].sort_values("bin")
        upto = np.cumsum(own["n"].to_numpy())
        out[i] = np.sinh((own["bin"].to_numpy()[np.searchsorted(upto, np.array([0.25, 0.5, 0.75]) * upto[-1])] + 0.5) / FINE)
    return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "q": [out.reshape(-1).tolist()]})


#: Bins per unit of the inverse hyperbolic sine of a statistic, for quartiles.
FINE = 256


def _started(batches):
    """The starts of each group from its quartiles, its moments and the moments of its signs (unit vectors from the medians)."""
    import pandas as pd

    for pdf in batches:
        rows = []
        for _, r in pdf.iterrows():
            q = np.array(r["q"], float).reshape(D, 3)
            scale = np.maximum((q[:, 2] - q[:, 0]) / 1.349, FLOORS)
            mean, cov = _moments(r[_MOMENTS].to_numpy(float), r["n"])
            signs = r[[f"s{i}" for i in range(D * D)]].to_numpy(float).reshape(D, D) / r["n"]
            # directions from the signs, spread along each from the quartile ranges
            values, vectors = np.linalg.eigh(signs + 1e-9 * np.eye(D))
            spread = ((vectors * scale[:, None]) ** 2).sum(axis=0)
            for start, (centre, own) in enumerate(((q[:, 1], np.diag(scale**2)), (mean, cov), (q[:, 1], (vectors * spread) @ vectors.T))):
                c, v = _fitted(centre, own)
                rows.append((r["grp"], start, c, v, int(r["n"]), float("inf")))
        yield pd.DataFrame(rows, columns=["grp", "start", "centre", "inverse", "n", "det"])


def _levels(named: DataFrame, min_rows: int) -> DataFrame:
    """(own, grp, levels): whose estimates hold for each (lang, source), and all groups whose estimates its documents take
    part in: those of a language, or of all, rest on all of its documents, not only on those of small groups."""
    sizes = named.groupBy("own", "of_lang").agg(F.sum(F.col("good").cast("int")).alias("size"))
    langs = sizes.groupBy("of_lang").agg(F.sum("size").alias("lang_size"), F.min("size").alias("least"))
    every = langs.agg((F.min(F.when(F.col("least") < min_rows, F.col("lang_size"))) < min_rows).alias("all_used"))
    grp = F.when(F.col("size") >= min_rows, F.col("own")).when(F.col("lang_size") >= min_rows, F.col("of_lang")).otherwise(F.lit(_ALL))
    lang_used = (F.col("lang_size") >= min_rows) & (F.col("least") < min_rows)
    levels = F.array_compact(F.array(F.when(F.col("size") >= min_rows, F.col("own")), F.when(lang_used, F.col("of_lang")), F.when(F.col("all_used"), F.lit(_ALL))))
    return sizes.join(langs, "of_lang").crossJoin(F.broadcast(every)).select("own", grp.alias("grp"), levels.alias("levels"))


def estimates(stats: DataFrame, min_rows: int = MIN_ROWS, steps: int = STEPS) -> DataFrame:
    """(own, grp, centre, inverse, det): the estimates that hold for each (lang, source). Vectors and each step's estimates
    are stored: a step is one small job."""
    named = stats.withColumns(_group_names() | {"x": F.array(*vector()), "good": ~base_failed()})
    names = written(_levels(named, min_rows), "quality-groups")
    rows = written(named.filter("good").select("own", "x").join(names, "own").select(F.explode("levels").alias("grp"), "x"), "quality-vectors")

    each = rows.select("grp", F.posexplode("x").alias("i", "v")).withColumn("bin", F.floor(F.asinh("v") * FINE).cast("int"))
    quartiles = written(each.groupBy("grp", "i", "bin").agg(F.count("*").alias("n")).groupBy("grp").applyInPandas(_quartiles, "grp string, q array<double>"), "quality-quartiles")
    off = [F.col("x")[i] - F.col("q")[i * 3 + 1] for i in range(D)]
    squares = sum((d * d for d in off), F.lit(0.0))
    signs = [F.sum(F.when(squares > 0, off[i] * off[j] / squares).otherwise(0.0)).alias(f"s{i * D + j}") for i in range(D) for j in range(D)]
    begun = rows.join(quartiles, "grp").groupBy("grp").agg(F.first("q").alias("q"), F.count("*").alias("n"), *_moment_sums(F.col("x")), *signs)
    fit = written(begun.mapInPandas(_started, FIT), "quality-start")
    for step in range(steps):
        distance = F.log(F.greatest(_quadratic(), F.lit(math.exp(LOW))))
        bins = rows.join(fit.select("grp", "start", "centre", "inverse"), "grp").withColumn("bin", F.least(F.ceil(distance * BINS), F.lit(HIGH * BINS)).cast("int"))
        counted_bins = bins.groupBy("grp", "start", "bin").agg(F.count("*").alias("n"), *_moment_sums(F.col("x")))
        fit = written(counted_bins.groupBy("grp", "start").applyInPandas(_concentrated, FIT), f"quality-step-{step + 1}")
    best = fit.groupBy("grp").agg(F.min_by(F.struct("centre", "inverse", "det", "n"), F.struct("det", "start")).alias("b")).filter(F.col("b.n") >= min_rows)
    return names.select("own", "grp").join(best.select("grp", "b.centre", "b.inverse", "b.det"), "grp", "left")


def judge(stats: DataFrame, fit: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """stats with base_failed, distance (squared; null without estimates) and kept."""
    keyed = stats.withColumns({"own": _group_names()["own"], "x": F.array(*vector())})
    joined = keyed.join(fit.select("own", "centre", "inverse"), "own", "left").withColumn("distance", _quadratic())
    failed = base_failed()
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).drop("own", "x", "centre", "inverse")


def contract(docs: DataFrame) -> DataFrame:
    """The columns of op4."""
    stats = written(statistics(docs), "quality")
    return judge(stats, written(estimates(stats), "quality-fit")).select("doc_id", *COUNTS, "base_failed", "kept", "distance")


def kept(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep; same columns. Statistics go to the shared folder, estimates to each reader,
    and the texts are judged where they are read, without a shuffle of them while the estimates are few."""
    stats = written(statistics(docs), "quality")
    fit = written(estimates(stats), "quality-fit")
    names = docs.columns
    hidden = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *(F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"))))
    schema = T.StructType(hidden.select("row", "lang", "source").schema.fields + [T.StructField(c, T.LongType()) for c in COUNTS])

    def run(batches):
        codes = WordCodes()
        for batch in batches:
            texts = byte_values(batch.column(2))
            rows = np.concatenate([counted(texts[part], codes) for part in chunks(texts)]) if texts else np.zeros((0, len(COUNTS)), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), batch.column(4), *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], names=["row", "lang", "source", *COUNTS]
            )

    counts = hidden.mapInArrow(trimmed(run), schema)
    return judge(counts, fit).filter("kept").select("row.*")

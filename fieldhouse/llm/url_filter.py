"""URL filter: host and path rules, and gradient-boosted trees on lexical features where no rule fits.

The trees are fitted by Spark's own learner from labelled urls (label 1: block) on a bounded, hash-drawn sample of them
(`most_rows`); scoring is a DataFrame transformation. A fifth of the sample is held out: on it the probability is chosen
from which urls are blocked, as the one of least cost, a url that is missed costing MISSED times one that is blocked wrongly;
where never to block is as cheap, nothing is blocked (`Figures` has precision, recall and the area under the curve).
Features: lengths, depth, digit ratio, entropy of the characters, numbers of parameters, hyphens and host labels, and
for the host's last two labels how often and how often blocked they are in the sample, smoothed; a url that trees are
fitted on takes these from the other folds, never from its own label. That suffix table has at most `most_rows` rows, so it
is broadcast.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: then up to "?", "#" or the end. Null
urls and urls without "://" have an empty host and path and fit no rule. Of fitting rules the longest wins. Without
labelled urls, or with one label only, the trees are replaced by that label (allow without any). Repeated urls are judged
alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldhouse.llm.util import written

#: (rule, verdict): host, then path. At most a few hundred; each url is tried against all.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
MOST_ROWS, TREES, DEPTH, SEED = 20_000, 10, 3, 11
#: Bins of probability in which held-out urls are counted; rows of a partition while trees are fitted.
BINS, PART_ROWS = 50, 5000
#: What a missed url costs, a wrongly blocked one being 1; folds of the suffix statistics.
MISSED, FOLDS = 2, 5
FEATURES = ["url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "n_params", "n_hyphens", "n_labels", "suffix_rows", "suffix_rate"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, _SPLIT, 1), UPPER, LOWER), F.regexp_extract(text, _SPLIT, 2)


def fitting(host: F.Column, path: F.Column, rules: list[tuple[str, str]]) -> F.Column:
    """The longest rule that fits, as (rule, verdict), else null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def _count(text: F.Column, what: str) -> F.Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def lexical(urls: DataFrame) -> DataFrame:
    """urls (url, host, path) with the lexical features and the suffix (last two host labels)."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    characters = F.array(*[F.lit(c) for c in LOWER + "0123456789" + "/:.-_?&=#%+"])
    lowered = F.translate(url, UPPER, LOWER)
    # sum of n log n over the characters' counts; characters outside the list count as unlike each other
    weight = F.aggregate(characters, F.lit(0.0), lambda acc, c: acc + _weight(F.length(lowered) - F.length(F.replace(lowered, c, F.lit("")))))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split(F.col("host"), r"\.")
    return urls.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": _count(F.col("path"), "/").cast("double"),
            "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / size,
            "entropy": F.log(size) - weight / size,
            "n_params": F.when(query == "", 0).otherwise(_count(query, "&") + 1).cast("double"),
            "n_hyphens": (_count(url, "-") + _count(url, "_")).cast("double"),
            "n_labels": F.size(labels).cast("double"),
            "suffix": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), "."),
        }
    )


def _weight(n: F.Column) -> F.Column:
    return F.when(n > 1, n * F.log(n.cast("double"))).otherwise(F.lit(0.0))


def _rates(counts: DataFrame, *more: str) -> DataFrame:
    return counts.select("suffix", *more, F.log1p("n").alias("suffix_rows"), ((F.col("bad") + 1) / (F.col("n") + 2)).alias("suffix_rate"))


def _with_suffixes(rows: DataFrame, suffixes: DataFrame, *more: str) -> DataFrame:
    joined = rows.join(F.broadcast(suffixes), ["suffix", *more], "left")
    return joined.withColumns({"suffix_rows": F.coalesce("suffix_rows", F.lit(0.0)), "suffix_rate": F.coalesce("suffix_rate", F.lit(0.5))})


def sampled(labelled: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """About most_rows of the labelled urls at most, drawn by a hash of the url."""
    n = labelled.count()
    if n <= most_rows:
        return labelled
    return labelled.filter(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(1_000_000 * most_rows / n))


@dataclass
class Figures:
    """What the held-out urls show: their number, how many are to be blocked, the probability from which urls are blocked (1
    and more: never), precision and recall there, and the area under the curve of the probabilities (urls of one bin count
    half)."""

    rows: int
    positives: int
    threshold: float
    precision: float
    recall: float
    area: float


class Trees:
    """Boosted trees, their suffix table, and the threshold chosen on held-out urls."""

    def __init__(self, labelled: DataFrame, most_rows: int = MOST_ROWS):
        """labelled: (url, label 0 or 1). Without two labels among the fitted urls there are no trees."""
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        host, path = split_url(F.col("url"))
        known = sampled(labelled.filter(F.col("label").isNotNull()).select("url", F.col("label").cast("double").alias("label")), most_rows)
        known = written(lexical(known.withColumns({"host": host, "path": path})), "labelled-urls")
        held = F.pmod(F.xxhash64("url", F.lit(SEED)), F.lit(5)) == 0
        fitted = known.filter(~held)
        counts = {r["label"]: r["n"] for r in fitted.groupBy("label").agg(F.count("*").alias("n")).collect()}
        self.constant, self.figures = "block" if set(counts) == {1.0} else "allow", None
        self.model = None
        if len(counts) < 2:
            return
        fold = F.pmod(F.xxhash64("url", F.lit(SEED + 1)), F.lit(FOLDS))
        by_fold = fitted.groupBy("suffix", fold.alias("fold")).agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
        self.suffixes = written(_rates(by_fold.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))), "suffixes")
        every = Window.partitionBy("suffix")
        others = _rates(by_fold.select("suffix", "fold", (F.sum("n").over(every) - F.col("n")).alias("n"), (F.sum("bad").over(every) - F.col("bad")).alias("bad")), "fold")
        self.assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        train = self.assembler.transform(_with_suffixes(fitted.withColumn("fold", fold), others, "fold")).select("features", "label").coalesce(max(1, sum(counts.values()) // PART_ROWS))
        self.model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED).fit(train)
        judged = self.scored(known.filter(held)).withColumn("bin", F.floor(F.col("p") * BINS).cast("int"))
        bins = judged.groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("bad")).collect()  # BINS rows at most
        self.figures = chosen({r["bin"]: (r["n"], r["bad"]) for r in bins})

    def scored(self, urls: DataFrame) -> DataFrame:
        """urls with lexical features, and p, the probability that they are to be blocked."""
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(self.assembler.transform(_with_suffixes(urls, self.suffixes)))
        return out.withColumn("p", vector_to_array("probability")[1])


def chosen(bins: dict[int, tuple[int, int]], missed: float = MISSED) -> Figures:
    """The threshold of least cost on held-out urls, from (urls, to be blocked) by bin of probability."""
    rows, bad = sum(n for n, _ in bins.values()), sum(b for _, b in bins.values())
    best, cost, area = Figures(rows, bad, 1.0 + 1 / BINS, 0.0, 0.0, 0.5), missed * bad, 0.0
    n = hits = 0
    for k in sorted(bins, reverse=True):
        area += (bins[k][0] - bins[k][1]) * (hits + bins[k][1] / 2)
        n, hits = n + bins[k][0], hits + bins[k][1]
        if missed * (bad - hits) + n - hits < cost:
            best, cost = Figures(rows, bad, k / BINS, hits / n, hits / bad, 0.5), missed * (bad - hits) + n - hits
    if 0 < bad < rows:
        best.area = area / (bad * (rows - bad))
    return best


def predicted(urls: DataFrame, labelled: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """urls (with url, host, path) with p, the trees' probability to block, and their verdict in `learned`; labelled: (url,
    label 0 or 1). Without trees p is null."""
    trees = Trees(labelled, most_rows)
    if trees.model is None:
        return urls.withColumns({"p": F.lit(None).cast("double"), "learned": F.lit(trees.constant)})
    return trees.scored(lexical(urls)).select(*urls.columns, "p", F.when(F.col("p") >= trees.figures.threshold, "block").otherwise("allow").alias("learned"))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]] = RULES, most_rows: int = MOST_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict of every url, with the trees' verdict and probability."""
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumn("host", host).withColumn("path", path)
    done = predicted(urls.withColumn("fit", fitting(F.col("host"), F.col("path"), rules)), labelled, most_rows)
    return done.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "learned").alias("verdict"), "learned", "p")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled urls: a page's url names the document that it shows, and labels judge documents. Poor quality: block."""
    number = F.regexp_extract(F.col("url"), r"/(\d+)(?:\.html?)?(?:[/?#]|$)", 1).try_cast("long")
    shown = pages.select("url", number.alias("doc_id")).filter("doc_id is not null")
    return shown.join(labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), "doc_id").select("url", (F.col("quality") == 0).cast("int").alias("label"))


def contract(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of op1."""
    return judge(pages, labelled_pages(pages, labels))

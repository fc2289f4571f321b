"""Search in names through stored postings of character grams.

`build` cuts each lower-cased name into grams of three characters and stores (gram, id) in folders by a hash of the gram. A
search takes the grams of its fixed parts (between the wild characters % and _), reads only their folders, keeps ids
that have them all, and verifies each by the pattern itself. A search whose fixed parts are all shorter than a gram, or
that is not in ASCII (small letters of other alphabets differ between engines), reads the names as a whole: the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM, FOLDERS = 3, 64


def _folder(gram):
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def build(names: DataFrame, path: str) -> None:
    """Stores the postings and names of (id, name); null names are not found."""
    rows = names.select(F.col("id").cast("string").alias("id"), "name").filter("name is not null").distinct()
    rows.write.parquet(f"{path}/names")
    lowered = F.lower("name")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(lowered) - GRAM + 1, F.lit(1))), lambda i: F.substring(lowered, i, F.lit(GRAM)))
    grams = names.sparkSession.read.parquet(f"{path}/names").select("id", "name", F.explode(F.array_distinct(cut)).alias("gram")).filter(F.length("gram") == GRAM)
    grams.withColumn("folder", _folder(F.col("gram"))).repartition("folder").sortWithinPartitions("gram").write.partitionBy("folder").parquet(f"{path}/grams")


def grams_of(q: str) -> list[str]:
    """The different grams of a search's fixed parts."""
    parts = re.split("[%_]", q.lower())
    return sorted({p[i : i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)})


def find(spark: SparkSession, path: str, q: str) -> DataFrame:
    """(id, name) of the names that hold q in any case; % stands for any characters and _ for one. A backslash takes the next
    character as it is."""
    holds = F.col("name").ilike(f"%{q}%")
    grams = grams_of(q) if q.isascii() and "\\" not in q else []
    if not grams:
        return spark.read.parquet(f"{path}/names").filter(holds)
    folders = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_folder(F.col("gram"))).distinct().collect()]  # of a search's own grams
    postings = spark.read.schema("id string, name string, gram string, folder int").parquet(f"{path}/grams")
    some = postings.filter(F.col("folder").isin(*folders) & F.col("gram").isin(*grams))
    return some.groupBy("id", "name").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).filter(holds).select("id", "name")

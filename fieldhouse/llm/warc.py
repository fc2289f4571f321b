"""A content-addressed WARC archive: payload bytes once by SHA-256, record headers apart, records rebuilt through joins.

`records` gives each page a WARC record: its exact header block (version line to blank line) and its payload. Of records
with equal payloads of at least LEAST bytes the one with the smallest page_id is a response, the others are revisits that
name it; smaller payloads are always responses. `write_archive` stores two tables: payloads (digest, bytes), each digest
once, and headers (page_id, url, header, digest). Only page ids and digests are grouped, so a payload shared by a third of
all pages is not a hot group. `reconstruct` joins both tables into whole records and fails where a record's payload is not
there; `parsed` reads headers with a few patterns; `read_archive` recomputes digest and length of every record's payload and
fails where the digest is not the header's.

Null html is an empty payload. Null urls give an empty target; a header's target has line ends percent-encoded, and the url
as it came stands beside the header. Repeated page_ids with equal payloads: one of the rows is
taken as first, all rows with that page_id are responses. Extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldhouse.llm.util import shared_dir

LEAST = 100
DATE = "2024-01-01T00:00:00Z"
PREFIX = "urn:page:"


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload bytes, their digest and length."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload")).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("length")
    )


def headers(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, url, header (exact bytes as text), digest, and the first page with that payload."""
    rows = payloads(pages).drop("payload")
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    kind = F.when((F.col("length") < LEAST) | F.col("page_id").eqNullSafe(F.col("first_id")), "response").otherwise("revisit")
    named = lambda c: F.concat(F.lit(f"<{PREFIX}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    joined = rows.join(firsts, "digest").withColumn("kind", kind)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("kind")),
        F.concat(F.lit("WARC-Record-ID: "), named("page_id")),
        F.lit(f"WARC-Date: {date}"),
        # a target is one header line: line ends inside an url are percent-encoded
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(F.col("kind") == "revisit", F.concat(F.lit("WARC-Refers-To: "), named("first_id"))),
        F.when(F.col("kind") == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(F.col("kind") == "revisit", F.lit(0)).otherwise(F.col("length"))),
    ]
    header = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))
    return joined.select("page_id", "url", header.alias("header"), "digest", "first_id")


def write_archive(pages: DataFrame, path: str) -> None:
    """Writes the two tables of an archive under path, a folder that all executors share."""
    spark = pages.sparkSession
    headers(pages).write.option("compression", "zstd").parquet(f"{path}/headers")
    store = spark.read.parquet(f"{path}/headers")
    # one page for each digest; only those pages' bytes are moved. Null ids join null ids.
    chosen = store.groupBy("digest", F.col("page_id").alias("chosen")).agg(F.count("*").alias("n")).groupBy("digest").agg(F.min_by(F.struct("chosen", "n"), F.struct(F.col("chosen").isNull(), "chosen")).alias("c")).select("digest", "c.*")
    bodies = payloads(pages).select("page_id", "digest", "payload")
    # where the chosen page stands several times with that payload, one of its rows is stored
    once, again = (_bodies_of(bodies, chosen.filter(test)) for test in ("n = 1", "n > 1"))
    once.unionByName(again.dropDuplicates(["digest"])).write.option("compression", "zstd").parquet(f"{path}/payloads")


def _bodies_of(bodies: DataFrame, chosen: DataFrame) -> DataFrame:
    same = bodies["digest"].eqNullSafe(chosen["digest"]) & bodies["page_id"].eqNullSafe(chosen["chosen"])
    return bodies.join(chosen, same).select(bodies["digest"], "payload")


def parsed(header: F.Column) -> dict[str, F.Column]:
    """The fields of a header block that readers need."""
    value = lambda name: F.nullif(F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)", 1), F.lit(""))
    number = lambda name: F.regexp_extract(value(name), rf"<{PREFIX}(-?\d+)>", 1).try_cast("long")
    return {
        "page_id": number("WARC-Record-ID"),
        "record_type": value("WARC-Type"),
        "payload_digest": F.regexp_extract(value("WARC-Payload-Digest"), "sha256:([0-9a-f]+)", 1),
        "refers_to": number("WARC-Refers-To"),
        "content_length": value("Content-Length").try_cast("long"),
    }


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """Whole original records: page_id, url, header, record (header, then the payload of responses, then the record's end) and
    payload. A record whose payload is not in the store fails the job."""
    heads, stored = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    lost = F.raise_error(F.concat(F.lit("missing payload "), "digest")).cast("binary")
    full = heads.join(stored, "digest", "left").withColumn("payload", F.coalesce("payload", lost))
    body = F.when(parsed(F.col("header"))["record_type"] == "response", F.col("payload")).otherwise(F.lit(b""))
    return full.select("page_id", "url", "header", F.concat(F.col("header").cast("binary"), body, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Per reconstructed record what its header says, and digest and length of its payload. A payload whose digest is not
    the header's fails the job: the store is corrupt."""
    rows = reconstruct(spark, path).select(*(c.alias(n) for n, c in parsed(F.col("header")).items()), "payload").withColumn("verified", F.sha2("payload", 256))
    corrupt = F.raise_error(F.concat(F.lit("corrupt payload "), F.col("payload_digest")))
    return rows.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(F.col("verified") == F.col("payload_digest"), F.col("verified")).otherwise(corrupt).alias("payload_digest"), "record_type", "refers_to"
    )


def contract(pages: DataFrame) -> DataFrame:
    """Writes the archive to the shared folder, then reads it back: the columns of op3."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    return read_archive(spark, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha256(body) AS digest, min(page_id) OVER (PARTITION BY sha256(body)) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n < 100 OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""

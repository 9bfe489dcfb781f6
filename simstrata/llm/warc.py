"""Operator 7: a content-addressed WARC archive.

``archive`` writes two tables. ``payloads`` holds the bytes of each distinct payload once, under its SHA-256 digest, and
``headers`` holds the exact header bytes of every record with the digest of its payload. ``reconstruct`` joins them back
to whole records and checks every payload against both of its digests and its length; a mismatch raises an error.

Of the records with equal payloads of at least ``min_bytes`` bytes the one with the largest id is the response and the
others are revisits of it; records with smaller payloads are all responses.

A payload that very many records share is replicated once per ``COPIES_PER_SALT`` of its records before the join, and
its records are dealt over the replicas, so no task gets a whole group.

Defined cases: a null payload is empty; a record with a null id is a revisit if a record with an id has the same large
payload, else a response; rows that repeat the largest id are all responses; null urls give an empty target; an empty
table gives empty tables; columns other than id, url and payload are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simstrata.llm.common import shared_dir

MIN_BYTES, COPIES_PER_SALT = 1000, 256
DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"


def _header(record_type: Column) -> Column:
    """Exact bytes of the WARC header block, the closing blank line included."""
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    is_revisit = record_type == "revisit"
    text = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        field("WARC-Type", record_type),
        field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">"))),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\r\n]", " ")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.when(is_revisit, F.sha2(F.lit(b""), 256)).otherwise(F.col("digest")))),
        field("X-Payload-SHA256", F.col("digest")),
        F.when(is_revisit, F.concat(
            field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("leader").cast("string"), F.lit(">"))),
        )).otherwise(""),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("X-Payload-Length", F.col("n_bytes").cast("string")),
        field("Content-Length", F.when(is_revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit(CRLF),
    )
    return F.encode(text, "UTF-8")


def archive(df: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES) -> None:
    """Write the tables ``payloads`` and ``headers`` below ``path``, a folder that all executors share."""
    body = F.coalesce(F.encode(F.col(payload), "UTF-8") if dict(df.dtypes)[payload] == "string" else F.col(payload), F.lit(b""))
    rows = df.select(F.col(id_col).alias("id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.length("payload").cast("long"))
    # One row per digest: equal keys meet map-side first, so a payload is shuffled once per task that holds it at most.
    grouped = rows.groupBy("digest").agg(
        F.max("id").alias("leader"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"),
        F.first("payload").alias("payload"),
    )
    salts = F.greatest(F.lit(1), F.ceil(F.col("copies") / COPIES_PER_SALT)).cast("int").alias("salts")
    grouped.select("digest", "leader", "n_bytes", salts, "payload").write.parquet(f"{path}/payloads")
    spark = df.sparkSession
    leaders = spark.read.parquet(f"{path}/payloads").select("digest", "leader", "salts", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    # The salts are known only after the join, so it goes over digest and a first, coarse salt of 16.
    coarse = leaders.where("salt = 0").drop("salt").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(15))))
    light = rows.select("id", "url", "digest", "n_bytes", F.sha1("payload").alias("sha1"))
    light = light.withColumn("c", F.pmod(F.xxhash64("id", "url"), F.lit(16)).cast("int"))
    joined = light.join(coarse, ["digest", "c"])
    first = (F.col("n_bytes") < min_bytes) | F.col("leader").isNull() | F.coalesce(F.col("id") == F.col("leader"), F.lit(False))
    record_type = F.when(first, "response").otherwise("revisit")
    headers = joined.select("id", "digest", F.pmod(F.xxhash64("id", "url"), F.col("salts")).cast("int").alias("salt"), _header(record_type).alias("header"))
    headers.write.parquet(f"{path}/headers")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: id, header, payload (of revisits too), verified against the digests in the header."""
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads").select("digest", "payload", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    # Hashed once per stored payload, before the join spreads it.
    payloads = payloads.withColumn("got_sha256", F.sha2("payload", 256)).withColumn("got_sha1", F.sha1("payload")).withColumn("got_bytes", F.length("payload").cast("long"))
    rows = headers.join(payloads, ["digest", "salt"], "left")
    text = F.decode("header", "UTF-8")
    field = lambda name, pattern: F.regexp_extract(text, f"\\r\\n{name}: {pattern}\\r\\n", 1)
    rows = rows.withColumn("record_type", field("WARC-Type", "(\\w+)")).withColumn("sha1", field("WARC-Payload-Digest", "sha1:(\\w+)"))
    rows = rows.withColumn("n_bytes", field("X-Payload-Length", "(\\d+)").cast("long"))
    refers = field("WARC-Refers-To", "<urn:page:(-?\\d+)>")
    rows = rows.withColumn("refers_to", F.when(refers != "", refers.cast("long")))
    good = (F.col("got_sha256") == F.col("digest")) & (F.col("got_sha1") == F.col("sha1")) & (F.col("got_bytes") == F.col("n_bytes"))
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match digest "), F.col("digest"))).cast("binary"))
    return rows.select("id", "header", checked.alias("payload"), "record_type", "refers_to", F.col("got_bytes").alias("n_bytes"), F.col("got_sha1").alias("sha1"))


def record_bytes(records: DataFrame) -> DataFrame:
    """(id, record): whole records in WARC form; those of revisits have an empty block."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.select("id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = reconstruct(spark, path)
    return records.select(
        F.col("id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        "record_type", "refers_to",
    )


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n < 1000 OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""

"""Content-addressed web archive: payloads once by digest, exact record headers apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.store import pinned

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary: each five hex digits are four base32 digits."""
    text = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(text, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _same(low: Column, high: Column, value: Column, why: str) -> Column:
    return F.when(low.eqNullSafe(high), value).otherwise(F.raise_error(F.lit(why)))


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``folder/payloads`` (digest, response_id, payload) and ``folder/records`` (digest, header).

    The digest is the payload's SHA-256. Copies shrink to one per task before the shuffle
    of payloads, and their lengths and SHA-1 digests must agree, else the job fails. Of equal payloads the
    record with the largest id is the response and the others are revisits that refer to it.
    Rows that repeat an id with its payload are records of the same type. A row without an
    id is a revisit where a copy has one, else a response. Strings are stored as UTF-8, a
    null payload as an empty one, a null URL without its field; line ends in a URL are
    escaped. Other columns are ignored. An empty table makes an empty archive.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumn("digest", F.unhex(F.sha2("payload", 256))).withColumn("sha1", base32_sha1(F.col("payload"))).withColumn("n", F.octet_length("payload"))
    held = own.groupBy("digest").agg(
        F.max("id").alias("response_id"), F.first("payload").alias("payload"),
        *(f(c).alias(f"{name}_{c}") for c in ("sha1", "n") for name, f in (("low", F.min), ("high", F.max))),
    )
    sure = _same(F.col("low_sha1"), F.col("high_sha1"), _same(F.col("low_n"), F.col("high_n"), F.col("payload"), "payloads differ"), "payloads differ")
    held.select("digest", "response_id", sure.alias("payload")).write.option("compression", "zstd").parquet(f"{folder}/payloads")

    first = own.sparkSession.read.parquet(f"{folder}/payloads").select("digest", "response_id")
    kind = F.when(F.col("id").eqNullSafe(F.col("response_id")), "response").otherwise("revisit")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisit = F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn("response_id")))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"), line("WARC-Type", F.col("kind")), line("WARC-Record-ID", urn("id")), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("kind") == "revisit", revisit).otherwise(""),
        line("Content-Type", F.lit("text/html")), line("Content-Length", F.when(F.col("kind") == "response", F.col("n").cast("string")).otherwise("0")), F.lit(END),
    )
    records = own.select("id", "url", "digest", "sha1", "n").join(first, "digest").withColumn("kind", kind)
    records.select("digest", header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{folder}/records")


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("header").cast("string"), f"\r\n{name}: ([^\r]*)\r\n", 1)


def _held(spark: SparkSession, folder: str) -> DataFrame:
    """``(digest, payload, payload_bytes, payload_digest)``; a payload that does not match its address fails the job."""
    held = spark.read.parquet(f"{folder}/payloads")
    payload = F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload does not match its digest")))
    held = held.select("digest", payload.alias("payload"))
    return held.select("digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, url, record)`` per record.

    Every payload is hashed again and must match its address. ``record`` holds the exact bytes of
    the record, rebuilt by a join: the header, for a response the payload, and the closing line ends. It is then read
    as a reader of the file would: the content is as long as its header says and is followed by the closing
    line ends alone, a response's content has the digest that the header states, and a revisit has no content and states
    the digest of the payload it refers to; otherwise the job fails. Length and digest of
    a response are those of the rebuilt content. An empty archive gives no rows.
    """
    found = pinned(
        spark.read.parquet(f"{folder}/records").join(_held(spark, folder), "digest"),
        _field("WARC-Type").alias("record_type"), _field("Content-Length").try_cast("long").alias("n"),
    )
    closing = F.lit(END + END).cast("binary")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    found = pinned(found, F.concat("header", body, closing).alias("record"), F.octet_length("header").alias("at"))
    content = F.col("record").substr(F.col("at") + 1, F.col("n").cast("int"))
    rest = F.col("record").substr((F.col("at") + F.col("n") + 1).cast("int"), F.lit(1 << 30))
    is_response = F.col("record_type") == "response"
    found = pinned(found.drop("payload", "digest"), F.when(is_response, base32_sha1(content)).otherwise(F.col("payload_digest")).alias("sum"), F.when(is_response, F.octet_length(content).cast("long")).otherwise(F.col("payload_bytes")).alias("size"), rest.alias("rest"))
    number = lambda name: F.regexp_extract(_field(name), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    whole = (F.col("rest") == closing) & (F.col("n") == F.when(is_response, F.col("payload_bytes")).otherwise(0)) & (_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sum")))
    return found.select(
        number("WARC-Record-ID").alias("page_id"), F.col("size").alias("payload_bytes"),
        F.when(whole, F.col("sum")).otherwise(F.raise_error(F.lit("a record does not match its header"))).alias("payload_digest"),
        "record_type", number("WARC-Refers-To").alias("refers_to"), F.nullif(_field("WARC-Target-URI"), F.lit("")).alias("url"), "record",
    )


def export_warc(archive: DataFrame, folder: str) -> None:
    """Write the ``record`` column as plain WARC files; the line ends that close a record are the writer's separator."""
    bare = F.col("record").substr(F.lit(1), F.octet_length("record") - 4).cast("string")
    archive.select(bare.alias("value")).write.option("lineSep", END + END).text(folder)

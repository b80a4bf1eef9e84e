"""A content-addressed WARC archive.

Two Parquet tables make an archive:

* ``payloads``: each distinct payload's bytes once, under their SHA-256, with the SHA-1 and
  length taken from those bytes;
* ``headers``: one row per record with the exact header bytes and the SHA-256 of its payload (and the page's id as a
  key of the table; what is read back comes from the header itself).

Reading back joins headers to payloads on the digest and verifies that the bytes hash to
the digest they are stored under, so a damaged or swapped payload is an error, never a
record.  Duplicates are found from digests alone (narrow rows); a payload is shuffled
once, after copies met in the same task have been merged.  The join on a digest that a
third of the records share is an ordinary sort-merge join, which AQE splits.

Which record is the response: of records with equal payloads of at least
``least_bytes``, the one with the largest id; the others are revisits that refer to it.
Smaller payloads are always responses.

Defined results.  A null payload is empty.  Repeated rows with the largest id are all
responses.  A null id is smaller than any id, and told apart from an empty one.  Ids may be numbers or any texts (they are
percent-encoded in the header).  Payloads are stored whole, however long.  Columns besides id, url and payload are not
read, so their names may clash.  An empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path

LEAST_BYTES = 1000
CRLF = "\r\n"


def _header(kind: Column, page: Column, url: Column, digest: Column, length: Column, refers: Column, date: Column) -> Column:
    """Header lines of a record, up to and with the blank line."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    urn = lambda x: F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(x.cast("string")), F.lit(">")), F.lit("<urn:none:>"))
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "")
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", urn(page)),
        line("WARC-Target-URI", clean),
        line("WARC-Date", date),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(kind == "revisit", F.concat(line("WARC-Refers-To", urn(refers)), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(length.cast("string"))),
        F.lit(CRLF),
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``pages`` as an archive under ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    records = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.sha2(payload, 256).alias("sha256"), payload.alias("payload"))
    stored = records.groupBy("sha256").agg(F.first("payload").alias("payload"), F.max("page_id").alias("newest"))
    stored.select("sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("length"), "newest", "payload").write.parquet(f"{path}/payloads")
    digests = pages.sparkSession.read.parquet(f"{path}/payloads").select("sha256", "sha1", "length", "newest")
    kind = F.when((F.col("length") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("newest")), F.lit("revisit")).otherwise(F.lit("response"))
    refers = F.when(F.col("kind") == "revisit", F.col("newest"))
    rows = records.drop("payload").join(digests, "sha256").withColumn("kind", kind).withColumn("refers_to", refers)
    rows.select("page_id", "sha256", _header(F.col("kind"), F.col("page_id"), F.col("url"), F.col("sha1"), F.col("length"), F.col("refers_to"), F.lit(date)).alias("header")).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record rebuilt: page_id, record_type, refers_to, header, payload; the payload's bytes are verified."""
    payloads = spark.read.parquet(f"{path}/payloads").select("sha256", "payload")
    sound = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary"))
    text = F.decode("header", "UTF-8")
    headers = spark.read.parquet(f"{path}/headers")
    rebuilt = headers.join(payloads.select("sha256", sound.alias("payload")), "sha256")
    kind = dict(headers.dtypes)["page_id"]
    lines = {name: rf"\r\n{name}: <urn:page:([^>]*)>\r\n" for name in ("WARC-Record-ID", "WARC-Refers-To")}
    page, refers = (F.when(text.rlike(p), F.url_decode(F.regexp_extract(text, p, 1))).cast(kind) for p in lines.values())
    return rebuilt.select(page.alias("page_id"), F.regexp_extract(text, r"\r\nWARC-Type: (\w+)\r\n", 1).alias("record_type"), refers.alias("refers_to"), "header", "payload")


def record_bytes(archive: DataFrame) -> DataFrame:
    """Records as a WARC file has them: header, block (none for a revisit), two line ends."""
    block = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return archive.select("page_id", F.concat("header", block, F.lit(CRLF * 2).cast("binary")).alias("record"))


def archive_report(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` to an archive, read it back, and describe each record from what was read."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archive(pages, path, **options)
    back = read_archive(spark, path)
    return back.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")

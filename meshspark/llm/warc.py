"""A content-addressed WARC archive, written and read with DataFrames alone.

Two tables hold it. `payloads` has the bytes of each distinct payload once, under their SHA-256.
`headers` has the exact header block of each record, as WARC/1.1 text, and the digest it points to.
A record is its header, an empty line, the payload and an empty line; a join on the digest restores it.
When an archive is read each payload is hashed again and compared with its address, and each header is
parsed from its text.

Of records with equal payloads of at least 100 bytes, the one of the smallest page_id is a response and
the others are revisits that refer to it; smaller ones are responses. A revisit has no block of its own:
its payload is that of the record it refers to.

The payloads cross the network once, dealt by page_id, so a payload of many pages makes no hot key.

Defined results: null html is an empty payload; a null page_id counts as larger than any other and
is left empty in the header; rows that repeat a response's page_id and payload are responses too; line
ends, blanks and control characters in a URL are written as %XX, and a null URL is left out. Rows that repeat a page_id share
its record id. Payloads may be of any length that fits a Spark value. Columns other than these three are not read. An
empty table makes an empty archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, table

SMALLEST, EOL = 100, "\r\n"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture; another may be given


def _url(url: Column) -> Column:
    for k in (*range(1, 33), 127):
        url = F.replace(url, F.lit(chr(k)), F.lit(f"%{k:02X}"))
    return url


def _header(length: Column, date: str) -> Column:
    """The header block of a record, from columns page_id, url, digest, record_type and refers_to."""

    def urn(c):
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    def line(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit(EOL))

    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit("WARC/1.1" + EOL),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", _url(F.col("url"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn("refers_to")), F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{EOL}"))).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(length).cast("string")),
    )


def write_archive(pages: DataFrame, at: str, work: Work, smallest: int = SMALLEST, date: str = DATE) -> None:
    """Write pages (page_id, url, html) as the tables at/payloads and at/headers."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    heads = work.save(keyed.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n")), "heads")
    owners = work.save(heads.groupBy("digest").agg(F.min("page_id").alias("owner")), "owners")  # saved, so that a hot digest can be split in the join
    other = (F.col("n") >= smallest) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    records = heads.join(owners, "digest").withColumn("record_type", F.when(other, "revisit").otherwise("response")).withColumn("refers_to", F.when(other, F.col("owner")))
    records.select("digest", _header(F.col("n"), date).alias("header")).write.option("compression", "zstd").parquet(f"{at}/headers")
    none = F.lit(-(1 << 63)).cast("long")  # plain keys, so that the grouping keeps the join's partitioning
    first = owners.select(F.coalesce("owner", none).alias("key"), "digest")
    kept = keyed.select(F.coalesce("page_id", none).alias("key"), "digest", "payload").join(first, ["key", "digest"], "left_semi")
    kept.groupBy("key", "digest").agg(F.first("payload").alias("payload")).select("digest", "payload").write.option("compression", "zstd").parquet(f"{at}/payloads")


def _field(name: str, pattern: str) -> Column:
    return F.regexp_extract("header", f"(?m)^{name}: {pattern}$", 1)


def read_archive(spark: SparkSession, at: str) -> DataFrame:
    """A row per record: page_id, url, record_type, refers_to, header, payload, and payload_bytes and
    payload_digest of the stored bytes. A payload that misses or doesn't match its address is an error."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{at}/payloads")
    stored = stored.select("digest", "payload", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    heads = spark.read.schema("digest string, header string").parquet(f"{at}/headers")
    heads = heads.select(
        _field("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("digest"),
        _field("WARC-Record-ID", "<urn:page:(-?\\d*)>").alias("id"),
        _field("WARC-Target-URI", "(.*)").alias("url"),
        _field("WARC-Type", "(\\w+)").alias("record_type"),
        _field("WARC-Refers-To", "<urn:page:(-?\\d*)>").alias("to"),
        _field("Content-Length", "(\\d+)").try_cast("long").alias("length"),
        "header",
    )
    joined = heads.join(stored, "digest", "left")
    sound = (F.col("payload_digest") == F.col("digest")) & ((F.col("record_type") == "revisit") | (F.col("length") == F.col("payload_bytes")))
    checked = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("archive record without its payload: "), "digest")))
    return joined.select(F.expr("try_cast(nullif(id, '') as bigint)").alias("page_id"), F.expr("nullif(url, '')").alias("url"), "record_type", F.expr("try_cast(nullif(to, '') as bigint)").alias("refers_to"), "header", "payload", "payload_bytes", checked.alias("payload_digest"))


def _record() -> Column:
    """The exact bytes of a record, from the columns of an archive that was read."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return F.concat(F.col("header").cast("binary"), F.lit(EOL.encode()), block, F.lit(2 * EOL).cast("binary"))


def records(archive: DataFrame) -> DataFrame:
    """(page_id, record): the exact bytes of each record of an archive that was read."""
    return archive.select("page_id", _record().alias("record"))


def export(archive: DataFrame, at: str) -> None:
    """Write the records as .warc text files by Spark's text writer, whose line separator ends each."""
    bare = records(archive).select(F.expr("substring(record, 1, octet_length(record) - 4)").cast("string").alias("value"))
    bare.write.option("lineSep", 2 * EOL).text(at)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages, reads the archive, restores the bytes of every record, and reports the payloads found in them."""
    work = Work(spark)
    at = work.path("archive")
    write_archive(table(spark, sf_dir, "pages"), at, work)
    found = read_archive(spark, at).withColumn("record", _record())
    head = F.octet_length("header") + len(EOL)
    block = F.substring("record", head + 1, F.octet_length("record") - head - 2 * len(EOL))
    payload = F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(block)  # a revisit's is the one it refers to
    found = found.select("page_id", "payload_digest", "record_type", "refers_to", payload.alias("body"))
    sound = F.when(F.sha2("body", 256) == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("record without its payload")))
    found = found.select("page_id", F.octet_length("body").cast("long").alias("payload_bytes"), sound.alias("payload_digest"), "record_type", "refers_to")
    return work.result(found)


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest, coalesce(html, '') AS h FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS owner FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND page_id <> owner THEN owner END AS refers_to FROM o
"""

"""Content-addressed WARC archive (operator 2).

``write_archive`` keeps two tables: ``payloads`` holds every distinct payload once under its SHA-256, ``records`` holds
the exact header bytes of every record.  ``read_archive`` rebuilds the records by joining the two and trusts nothing:
each stored payload is digested again and must have the name it is stored under, and each rebuilt record is parsed from
its bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_SHARED = 100                        # payloads below this many bytes never become revisits
DATE = "2024-01-01T00:00:00Z"           # the tables have no crawl time
END = "\r\n"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(END))


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def _header(date: str) -> Column:
    """Header block of a record, with the empty line.  Line breaks and percent signs in the URL are percent-encoded."""
    url = F.replace(F.replace(F.replace("url", F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit("WARC/1.1" + END), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        F.coalesce(_line("WARC-Target-URI", url), F.lit("")), F.lit(f"WARC-Date: {date}{END}"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _record_id(F.col("refers_to"))),
                                 F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + END))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8" + END),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))), F.lit(END)).cast("binary")


def write_archive(pages: DataFrame, folder: str, min_shared: int = MIN_SHARED, date: str = DATE) -> None:
    """Write ``folder/payloads`` and ``folder/records`` for the columns page_id, url, html.

    Null html is an empty payload, a null url leaves its header line out, a null page_id gives an empty record name.
    Of equal payloads the smallest non-null page_id is the response; rows that repeat it are responses too.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # copies collapse inside each task, then one row per digest and task is merged: no hot group
    store = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.any_value("payload").alias("payload"))
    store.write.option("compression", "zstd").parquet(f"{folder}/payloads")
    spark = pages.sparkSession
    owner = spark.read.parquet(f"{folder}/payloads").select("digest", "first_id")
    revisit = (F.col("bytes") >= min_shared) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    records = (rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes")).join(owner, "digest")
               .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
               .withColumn("refers_to", F.when(revisit, F.col("first_id"))))
    records.select("digest", "record_type", _header(date).alias("header")).write.option("compression", "zstd").parquet(f"{folder}/records")


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads under names that are checked against their bytes."""
    kept = spark.read.parquet(f"{folder}/payloads").select("digest", "payload")
    same = F.sha2("payload", 256) == F.col("digest")
    return kept.select("digest", F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not have its digest")).cast("binary")).alias("payload"))


def rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Every record as its exact bytes: ``digest, record`` (header, block, two line ends); a revisit has no block."""
    records = spark.read.parquet(f"{folder}/records")
    whole = (records.where("record_type = 'response'").join(_stored(spark, folder), "digest")
             .select("digest", F.concat("header", "payload", F.lit(END * 2).cast("binary")).alias("record")))
    bare = records.where("record_type <> 'response'").select("digest", F.concat("header", F.lit(END * 2).cast("binary")).alias("record"))
    return whole.unionByName(bare)


def _field(name: str) -> Column:
    return F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def _page(name: str) -> Column:
    return F.nullif(F.regexp_extract(_field(name), r"^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record, from the records' bytes: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``.

    A revisit's length is that of the stored payload its digest names.
    """
    head = F.concat(F.substring_index(F.col("record").cast("string"), END * 2, 1), F.lit(END))
    cut = rebuilt(spark, folder).withColumn("head", head).withColumn("at", F.octet_length("head") + 2)
    length = _field("Content-Length").cast("int")
    parsed = cut.select(
        _page("WARC-Record-ID").alias("page_id"), _field("WARC-Type").alias("record_type"), _page("WARC-Refers-To").alias("refers_to"),
        F.nullif(_field("WARC-Target-URI"), F.lit("")).alias("url"), F.substring(_field("WARC-Payload-Digest"), 8, 64).alias("named"),
        length.cast("long").alias("n"), F.substring(F.col("record"), F.col("at") + 1, length).alias("block"), "digest")
    url = F.replace(F.replace(F.replace("url", F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
    parsed = parsed.withColumn("url", url)
    whole = parsed.where("record_type = 'response'").select(
        "page_id", "url", F.octet_length("block").cast("long").alias("payload_bytes"),
        F.when((F.sha2("block", 256) == F.col("named")) & (F.octet_length("block") == F.col("n")), F.col("named"))
        .otherwise(F.raise_error(F.lit("a record's block does not have its digest"))).alias("payload_digest"), "record_type", "refers_to")
    sizes = _stored(spark, folder).select(F.col("digest").alias("named"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    bare = parsed.where("record_type = 'revisit'").join(sizes, "named").select(
        "page_id", "url", "payload_bytes", F.col("named").alias("payload_digest"), "record_type", "refers_to")
    return whole.unionByName(bare)


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM w
"""

"""Content-addressed WARC archives: payloads once by verified SHA-256, exact headers apart, records by joins.

An archive is a folder of two tables.  ``payloads`` (digest, payload) has every distinct payload once;
``records`` (page_id, digest, header) the exact header bytes of every record, in WARC/1.1.  A reader
recomputes each payload's digest, joins it to the headers, and fails on a mismatch; records are parsed from
their reconstructed bytes, a revisit's payload is that of the record it refers to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, lookup, stash

#: Payloads of so many bytes and more may be revisits of an equal one.
REVISIT_BYTES = 1000
CRLF = "\r\n"
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, *value: F.Column) -> F.Column:
    """A header line; none where a part of the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), *value, F.lit(CRLF)), F.lit(""))


def _urn(page_id: F.Column) -> F.Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Write a record per row. Of equal payloads of REVISIT_BYTES or more, the largest id's is the response.

    A null body is the empty payload, a null url has no target line, control characters in a url are
    percent-encoded.  Rows that repeat an id and a payload are all responses; so are rows whose id is null.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    facts = stash(rows.select("page_id", "url", "digest", F.length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1")))
    groups = facts.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
    shared = stash(groups.where("copies > 1").drop("copies"))
    n_shared = shared.count()
    shared = lookup(shared, n_shared if n_shared <= BROADCAST_ROWS // 8 else BROADCAST_ROWS + 1)

    known = rows.select("page_id", "digest", "payload").join(shared.withColumn("many", F.lit(True)), "digest", "left")
    once = known.where("many is null").select("digest", "payload")
    first = known.where("many and (page_id = keeper or keeper is null)").select("digest", "payload").dropDuplicates(["digest"])
    once.unionByName(first).write.option("parquet.block.size", 32 << 20).parquet(f"{path}/payloads")

    heads = facts.join(shared, "digest", "left").withColumn("again", (F.col("n") >= REVISIT_BYTES) & F.coalesce(F.col("page_id") != F.col("keeper"), F.lit(False)))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x1F\\x7F]", "%00")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Target-URI", url),
        _line("WARC-Date", F.lit(_DATE)),
        _line("WARC-Payload-Digest", F.lit("sha1:"), F.col("sha1")),
        F.when(F.col("again"), F.concat(_line("WARC-Refers-To", _urn(F.col("keeper"))), _line("WARC-Profile", F.lit(_PROFILE)))).otherwise(""),
        _line("Content-Type", F.lit("application/octet-stream")),
        _line("Content-Length", F.when(F.col("again"), F.lit(0)).otherwise(F.col("n")).cast("string")),
        F.lit(CRLF),
    )
    heads.select("page_id", "digest", header.cast("binary").alias("header")).write.parquet(f"{path}/records")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload; reading a payload that isn't its digest's fails."""
    rows = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    right = F.sha2("payload", 256) == F.col("digest")
    return rows.withColumn("payload", F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "digest"))))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record: the exact bytes of every record (a revisit's block is empty).

    Payloads join only the records that hold them.
    """
    heads = spark.read.schema("page_id long, digest string, header binary").parquet(f"{path}/records")
    again = F.col("header").cast("string").contains(f"{CRLF}WARC-Type: revisit{CRLF}WARC-Record-ID: ")
    end = F.lit(CRLF * 2).cast("binary")
    full = heads.where(~again).join(read_payloads(spark, path), "digest", "left")
    payload = F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload for "), "digest")).cast("binary"))
    return full.select("page_id", F.concat("header", payload, end).alias("record")).unionByName(heads.where(again).select("page_id", F.concat("header", end).alias("record")))


def parsed(records: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, stated (the SHA-1 in the header), sha1 and n (of the block) of ``record`` bytes.

    The header ends at the first empty line, the block has Content-Length bytes, and two line ends close the record.
    """
    rows = records.select("record", F.expr("instr(decode(record, 'ISO-8859-1'), '\\r\\n\\r\\n')").alias("gap"))
    rows = rows.withColumn("header", F.expr("decode(substring(record, 1, gap + 1), 'UTF-8')"))

    def value(name: str, pattern: str) -> F.Column:
        found = F.regexp_extract("header", rf"\r\n{name}: {pattern}\r\n", 1)
        return F.when(found != "", found)

    rows = rows.withColumn("size", value("Content-Length", r"(\d+)").cast("long")).withColumn("block", F.expr("substring(record, cast(gap + 4 as int), cast(size as int))"))
    whole = (F.length("record") == F.col("gap") + 3 + F.col("size") + 4) & (F.expr("substring(record, -4)") == F.lit(CRLF * 2).cast("binary"))
    kind = F.when(whole, value("WARC-Type", r"(\w+)")).otherwise(F.raise_error(F.lit("a record's length differs")))
    return rows.select(
        value("WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("long").alias("page_id"), kind.alias("record_type"), value("WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long").alias("refers_to"),
        value("WARC-Payload-Digest", "sha1:([0-9a-f]+)").alias("stated"), F.sha1("block").alias("sha1"), F.length("block").cast("long").alias("n"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_digest and payload_bytes of every record, from its reconstructed bytes.

    A response's payload is its block, a revisit's the block of the response that it refers to; the SHA-1 in the
    header must be the payload's.  Repeated and null ids stay rows of their own; an empty archive gives none.
    """
    rows = stash(parsed(reconstruct(spark, path)))
    differs = lambda what: F.raise_error(F.concat(F.lit(f"{what} "), F.coalesce(F.col("stated"), F.lit("-"))))
    held = rows.where("record_type != 'revisit'").withColumn("payload_digest", F.when(F.col("stated") == F.col("sha1"), F.col("sha1")).otherwise(differs("another payload than")))
    named = held.where(F.col("n") >= REVISIT_BYTES).select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated"), F.col("n").alias("payload_bytes")).distinct()
    again = rows.where("record_type = 'revisit'").join(named, ["refers_to", "stated"], "left").withColumn("payload_bytes", F.coalesce("payload_bytes", differs("no response with").cast("long")))
    out = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return held.withColumn("payload_bytes", F.col("n")).select(*out).unionByName(again.withColumn("payload_digest", F.col("stated")).select(*out))


def export(spark: SparkSession, path: str, to: str, compression: str = "none") -> None:
    """Write an archive's records as .warc text: files of records one after another, each closed by two line ends."""
    body = F.expr("cast(substring(record, 1, cast(length(record) - 2 as int)) as string)")  # the writer adds the last line end
    reconstruct(spark, path).select(body.alias("value")).write.option("lineSep", CRLF).option("compression", compression).text(to)

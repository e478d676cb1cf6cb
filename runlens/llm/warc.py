"""WARC archives with revisit resolution.

``write_archives``: headers (id, digest, length) alone are shuffled by payload
digest to choose, of equal payloads of at least ``min_bytes``, the row with the
largest id as the response; the others become revisit records that refer to
it. The choice is joined to the pages by (id, digest), which shuffles payloads
once, never by digest alone; archives are then written with fresh headers by the
executors through Spark (any store). ``read_archives`` frames records by Content-Length and checks each response
against its digest; ``resolve_revisits`` joins revisit records back to their
responses.

Defined results: a null payload is empty; a null id is written as such, counts
as smallest and reads back as null; of repeated rows with one id and payload
(at least ``min_bytes`` long) one is the response and the rest refer to that
id; null urls have no target URI, and blanks and control characters in urls
are percent-coded; an empty table gives no records; other columns are not
read. An archive file holds at most ``file_bytes``, or one longer record.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import expand, join_skewed, materialise, new_path, text_or_empty

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
URN = "urn:x-page:"
END = "\r\n\r\n"
RECORDS = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary, payload_bytes long"


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{URN}"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def plan_revisits(headers: DataFrame, min_bytes: int) -> DataFrame:
    """(id, digest, refers_to) of the rows whose payload another row holds."""
    large = headers.where(F.col("size") >= min_bytes)
    best = large.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    best = materialise(best, "warc-best")
    total = best.agg(F.sum("n")).first()[0] or 0
    return join_skewed(large.select("id", "digest").distinct(), best, ["digest"], "n", total).drop("n")


def _records(rows: DataFrame, date: str) -> DataFrame:
    """(value): the record of each row of (id, url, body, digest, refers_to); a
    row that refers to another is a revisit."""
    again = F.col("refers_to").isNotNull()
    block = F.when(again, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("body")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.col("id"))),
        F.lit(f"WARC-Date: {date}\r\n"),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\n"), line("WARC-Refers-To", _urn(F.col("refers_to"))))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    return rows.select(record.alias("value"))


def _split_repeated(rows: DataFrame) -> DataFrame:
    """Of rows with one id and payload that are to be the response, one is, the
    one with the first url; the others refer to that id."""
    key = ["id", "digest"]
    mine = F.col("refers_to").eqNullSafe(F.col("id"))
    body = F.min(F.struct(F.col("url").isNull().alias("none"), "url", "body")).alias("one")
    one = rows.where(mine).groupBy(*key).agg(body).select("id", "one.url", "one.body", "digest", F.lit(None).cast("long").alias("refers_to"))
    counts = rows.where(mine).groupBy(*key, "url").agg(F.count(F.lit(1)).alias("copies"))
    urls = F.min(F.struct(F.col("url").isNull().alias("none"), "url")).over(W.partitionBy(*key))
    counts = counts.withColumn("first", urls).withColumn("copies", F.col("copies") - F.col("url").eqNullSafe(F.col("first.url")).cast("long"))
    rest = expand(counts.where("copies > 0").select("id", "url", F.lit("").alias("body"), "digest", F.col("id").alias("refers_to"), "copies"))
    return rows.where(~mine).unionByName(one).unionByName(rest)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000, file_bytes: int = 32 << 20, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write one record per row of ``pages`` below ``path``; returns it."""
    body = text_or_empty(payload_col)
    digest = F.sha1(body.cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("body"), digest.alias("digest"))
    headers = materialise(rows.select("id", "digest", F.octet_length("body").cast("long").alias("size")), "warc-headers")
    repeated = headers.where(F.col("size") >= min_bytes).groupBy("id", "digest").count().where("count > 1").limit(1).count() > 0
    plan = plan_revisits(headers, min_bytes).withColumnsRenamed({"id": "_id", "digest": "_digest"})
    rows = rows.join(plan, rows["id"].eqNullSafe(plan["_id"]) & (rows["digest"] == plan["_digest"]), "left").drop("_id", "_digest")
    if repeated:
        rows = _split_repeated(rows)
    else:
        rows = rows.withColumn("refers_to", F.when(~F.col("refers_to").eqNullSafe(F.col("id")), F.col("refers_to")))

    def fill(batches):
        """Records one behind the other, a value for each file."""
        held, size = [], 0
        file = lambda: pa.record_batch([pa.array([END.join(held)], pa.string())], names=["value"])
        for batch in batches:
            for value in batch.column("value").to_pylist():
                n = len(value.encode()) + len(END)
                if held and size + n > file_bytes:
                    yield file()
                    held, size = [], 0
                held.append(value)
                size += n
        if held:
            yield file()

    files = _records(rows, date).mapInArrow(fill, "value string")
    files.write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", 1).text(path)
    return path


def _urn_id(value: str | None) -> int | None:
    value = (value or "").strip("<>").removeprefix(URN)
    return int(value) if value and value != "null" else None


def parse_records(data: bytes):
    """(headers, block) of each record, framed by Content-Length."""
    at = 0
    while at < len(data):
        head = data.index(END.encode(), at)
        lines = data[at:head].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        begin = head + len(END)
        end = begin + int(headers["Content-Length"])
        if data[end : end + len(END)] != END.encode():
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, data[begin:end]
        at = end + len(END)


def _rows(batches):
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64()]
    for batch in batches:
        for content in batch.column("content"):
            out, held = [], 0
            for h, block in parse_records(zlib.decompress(content.as_py(), 31)):
                kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                payload = block[block.index(END.encode()) + len(END) :] if kind == "response" else None
                if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its digest")
                refers = _urn_id(h.get("WARC-Refers-To"))
                out.append((_urn_id(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), kind, digest, refers, payload, None if payload is None else len(payload)))
                held += len(block)
                if held > 4 << 20:
                    yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(_rows, RECORDS)


def resolve_revisits(records: DataFrame, columns: tuple[str, ...] = ("payload", "payload_bytes")) -> DataFrame:
    """Fill ``columns`` of revisit records from the responses they refer to.

    ``records`` is read several times: give a table if reading them is costly.
    """
    key = ["payload_digest", "refers_to"]
    held = records.where("record_type = 'response'")
    again = records.where("record_type = 'revisit'")
    asked = again.groupBy(*key).agg(F.count(F.lit(1)).alias("_asked"))
    target = held.select("payload_digest", F.col("page_id").alias("refers_to"), *columns).join(asked, key)
    if set(columns) <= {"payload_bytes"}:  # short rows: entries for hot keys can be broadcast
        target = materialise(target, "warc-targets")
        total = target.agg(F.sum("_asked")).first()[0] or 0
        found = join_skewed(again.drop(*columns), target, key, "_asked", total)
    else:
        found = again.drop(*columns).join(target, key)
    return held.unionByName(found.select(*records.columns))

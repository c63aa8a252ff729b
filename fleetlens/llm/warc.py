"""WARC archives of page captures: written as text, read back as files, assembled into one nested row per capture.

Each capture is three records: request, response (or revisit, if an equal payload is archived elsewhere) and metadata;
request and metadata name the response in WARC-Concurrent-To. The writer is Spark's own text writer: a WARC record ends
with two line ends, which is the separator between rows. Reading takes the files of the folder in any order; records
are told apart by Content-Length alone.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import Scratch, hot_join, sized

LEAST_BYTES = 100  # of a payload that is archived once
FILE_RECORDS = 15_000  # of one archive file
CRLF = "\r\n"
#: Fixed strings of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _id(kind: str, *of: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in of]))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column | str, headers: list[tuple[str, Column]], mime: str, block: Column) -> Column:
    """A record without its last two line ends; headers that are null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind)]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in headers]
    lines += [F.lit(f"Content-Type: {mime}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def write_archives(pages: DataFrame, folder: str, tmp: Scratch) -> None:
    """Archives ``pages(page_id, url, html)``; of equal payloads of at least 100 bytes the smallest page_id's is kept."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), body.alias("body"))
    digest, size = F.sha2("body", 256).alias("digest"), F.octet_length("body").cast("long").alias("size")
    seen = tmp.keep(base.select("page_id", "url", digest, size).where("size >= %d and page_id is not null" % LEAST_BYTES), "payloads")
    first = seen.groupBy("digest", "size").agg(F.min(F.struct(F.col("page_id").alias("first"), F.col("url").alias("first_url"))).alias("f"), F.max("page_id").alias("last")).where("f.first < last")
    first = first.select("digest", "size", "f.first", "f.first_url")
    again = tmp.keep(hot_join(seen, first, ["digest", "size"], "inner").where("page_id > first").select("page_id", "digest", "first", "first_url").distinct(), "revisits")
    rows = base.select("page_id", "url", "body", digest, size).withColumn("mark", F.xxhash64("page_id", "url", "digest"))
    # rows that are equal in everything get a number each, which makes their record ids differ; the others are not shuffled
    equal = tmp.keep(rows.groupBy("mark").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("mark"), "equal-rows")
    some = rows.join(sized(equal, 200_000), "mark", "left_semi").groupBy("page_id", "url", "digest", "size").agg(F.min("body").alias("body"), F.count(F.lit(1)).alias("n"))
    some = some.select("page_id", "url", "body", "digest", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    rows = rows.join(sized(equal, 200_000), "mark", "left_anti").select("page_id", "url", "body", "digest", "size", F.lit(0).cast("long").alias("copy")).unionByName(some)
    # the revisits meet the pages by id, which is unique; pages are shuffled only if there are very many revisits
    ids = again.select("page_id", F.col("digest").alias("of"), "first", "first_url")
    rows = rows.join(sized(ids, 200_000), (rows["page_id"] == ids["page_id"]) & (rows["digest"] == ids["of"]), "left").select(rows["page_id"], "url", "body", rows["digest"], "size", "copy", "first", "first_url")
    uri = F.regexp_replace("url", "[\\x00-\\x20]", "%20")
    capture = [F.col(c) for c in ("page_id", "digest", "url", "copy")]
    own = _id("response", *capture)
    other = F.when(F.col("first").isNotNull(), _id("response", F.col("first"), F.col("digest"), F.col("first_url"), F.lit(0)))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    common = [("WARC-Target-URI", uri), ("WARC-Date", F.lit(DATE))]
    response = _record(F.when(F.col("first").isNull(), "response").otherwise("revisit"), [
        ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Refers-To", other), ("WARC-Profile", F.when(F.col("first").isNotNull(), PROFILE))],
        "application/http;msgtype=response", F.concat(http, F.when(F.col("first").isNull(), F.col("body")).otherwise("")))
    ask = F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1" + CRLF + CRLF))
    request = _record("request", [("WARC-Record-ID", _id("request", *capture)), ("WARC-Concurrent-To", own), *common], "application/http;msgtype=request", ask)
    fields = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _record("metadata", [("WARC-Record-ID", _id("metadata", *capture)), ("WARC-Concurrent-To", own), *common], "application/warc-fields", fields)
    out = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    out.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(folder)
    tmp.drop(seen, again, equal)


def _parse(with_payload: bool):
    def records(data: bytes) -> Iterator[tuple]:
        f = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
        while line := f.readline():
            if not line.strip():
                continue
            head: dict[str, str] = {}
            while (h := f.readline()) not in (b"\r\n", b"\n", b""):
                k, _, v = h.decode("utf-8", "replace").partition(":")
                head[k.strip().lower()] = v.strip()
            block = f.read(int(head.get("content-length", 0)))
            kind = head.get("warc-type")
            payload = page = None
            if kind == "response":
                payload = block[block.find(b"\r\n\r\n") + 4 :]
            elif kind == "metadata":
                page = next((int(x[8:]) for x in block.splitlines() if x.startswith(b"page_id:") and x[8:].strip()), None)
            yield (kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-target-uri"), head.get("warc-refers-to"), page,
                   None if payload is None else len(payload), None if payload is None else hashlib.sha256(payload).hexdigest()) + ((payload,) if with_payload else ())

    kinds = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string()] + [pa.binary()] * with_payload
    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["payload"] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                rows: list[tuple] = []
                held = 0
                for r in records(data.as_py()):
                    rows.append(r)
                    held += 300 + (len(r[-1] or b"") if with_payload else 0)
                    if held > 16_000_000:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


SCHEMA = "kind string, record_id string, concurrent_to string, uri string, refers_to string, page_id long, payload_bytes long, payload_digest string"


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of all archive files of a folder; sizes and digests of payloads are taken from what is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where("length > 0").select("content")
    return files.mapInArrow(_parse(with_payload), SCHEMA + (", payload binary" if with_payload else ""))


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: records that name the same response in WARC-Concurrent-To, and that response.

    Records of other types are left out; a capture lacking a record has null there. A record archived twice counts once.
    """
    key = F.when(F.col("kind").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    cols = [c for c in records.columns if c not in ("kind", "concurrent_to")]
    of = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.struct(*([F.col("kind")] + [F.col(c) for c in cols]))))
    known = records.where(F.col("kind").isin("request", "response", "revisit", "metadata") & key.isNotNull())
    return known.groupBy(key.alias("capture")).agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata"))


def archive_pages(pages: DataFrame, tmp: Scratch | None = None) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` per page, from the archives written and read back.

    The payload is the html in UTF-8, null counts as empty. Payloads under 100 bytes are archived as often as they occur.
    A revisit has the size and digest of the payload it refers to. Every row is a capture and gives a row, also one that
    repeats an id or all of another row; rows that repeat the smallest page_id of a payload are all responses. Pages
    without an id are always responses. Extra columns are ignored; empty gives empty.
    """
    spark = pages.sparkSession
    tmp = tmp or Scratch(spark)
    folder = tmp.path("archives")
    write_archives(pages, folder, tmp)
    got = captures(read_archives(spark, folder, with_payload=False))
    flat = tmp.keep(got.select("capture", F.col("metadata.page_id").alias("page_id"), F.col("response.kind").alias("record_type"), F.col("response.refers_to").alias("to"),
                               F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest")), "captures")
    tmp.delete(folder)
    target = flat.where("record_type = 'response'").select(F.col("capture").alias("to"), F.col("page_id").alias("first"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    again = hot_join(flat.where("record_type = 'revisit'"), target, ["to"])
    plain = flat.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return plain.unionByName(again.select("page_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", F.col("first").alias("refers_to")))


ORACLE = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select p.page_id, p.payload_bytes, p.payload_digest, case when first < page_id then 'revisit' else 'response' end as record_type,
case when first < page_id then first end as refers_to from p left join f on p.payload_digest = f.payload_digest and p.payload_bytes >= 100
"""

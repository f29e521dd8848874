"""WARC: transaction assembly.

``write_archives`` writes each page as a transaction of three records (request, response or revisit, metadata), each a
gzip member of a WARC 1.1 file; request and metadata name the response in ``WARC-Concurrent-To``. Of records with equal
payloads of ``LEAST_SHARED`` bytes or more, that of the smallest page_id is the response and the others revisit it.
``read_records`` parses archives, a file per task, and ``assemble`` joins the records through their concurrent-to
identifiers into one nested row per capture; ``resolve`` joins revisits to the responses that they refer to.

Defined results: a null payload is empty; null urls have no target header; a null page_id comes after all others and is
written as absent; rows that repeat (page_id, url, payload) repeat as captures, and share their record identifiers;
records without a response are left out of ``assemble``, responses without request or metadata have null there; an
empty table gives no archive; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docjobs.llm.common import shared_dir, small_batches, written

#: Payloads below so many bytes are always responses.
LEAST_SHARED = 100
#: Bytes of the table of shared payloads up to which it is broadcast.
MOST_BROADCAST = 8 << 20
DATE = "2024-01-01T00:00:00Z"
_RECORD = "record_id string, type string, uri string, date string, concurrent_to string, refers_to string, declared_digest string, fields map<string,string>, payload_bytes long, payload_digest string"


def _urn(kind: str, key: str) -> str:
    h = hashlib.md5(f"{kind} {key}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _record(kind: str, record_id: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers if v is not None]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(head + block + b"\r\n\r\n") + z.flush()


def _clean(url: str | None) -> str | None:
    return None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def transaction(page_id: int | None, url: str | None, payload: bytes, digest: str, key: str, first: str | None, first_key: str | None) -> bytes:
    """The three records of a page; first_key names the capture that it revisits, if any."""
    target, own = _clean(url), _urn("response", key)
    host = (target or "").split("://")[-1].split("/")[0]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if first_key is None:
        main = _record("response", own, [*body, ("Content-Type", "application/http; msgtype=response")], http + payload)
    else:
        again = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn("response", first_key)), ("WARC-Refers-To-Target-URI", _clean(first))]
        main = _record("revisit", own, [*body, *again, ("Content-Type", "application/http; msgtype=response")], http)
    link = [("WARC-Target-URI", target), ("WARC-Concurrent-To", own)]
    ask = _record("request", _urn("request", key), [*link, ("Content-Type", "application/http; msgtype=request")], f"GET {target or '/'} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
    note = "" if page_id is None else f"page-id: {page_id}\r\n"
    return ask + main + _record("metadata", _urn("metadata", key), [*link, ("Content-Type", "application/warc-fields")], note.encode())


def _key(page_id: Column, url: Column, digest: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("-")), digest, F.coalesce(url, F.lit("-")))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> list[str]:
    """Writes one archive for each part of pages below folder; returns the names of the files."""
    small_batches(pages.sparkSession)
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    size = F.octet_length("payload")
    own = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")
    shared = rows.filter(size >= LEAST_SHARED).select("digest", own.alias("own")).groupBy("digest").agg(F.min("own").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.lit(True).alias("shared"))
    first = written(shared, "shared-payloads")
    # only equal page ids make a row the response, so rows that repeat the smallest id stay responses
    joined = rows.select("page_id", "url", "payload", "digest").join(F.broadcast(first) if is_small(first) else first, "digest", "left")
    revisit = F.col("shared") & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    ready = joined.select("page_id", "url", "payload", "digest", _key(F.col("page_id"), F.col("url"), F.col("digest")).alias("key"), F.when(revisit, F.col("first_url")).alias("first"), F.when(revisit, _key(F.col("first_id"), F.col("first_url"), F.col("digest"))).alias("first_key"))

    def archive(batches):
        out, home = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name, temp, n = f"{task.partitionId():07d}.warc.gz", f"{home}/.{task.partitionId()}-{task.taskAttemptId()}", 0
        with out.open_output_stream(temp, compression=None) as f:
            f.write(_record("warcinfo", _urn("warcinfo", name), [("Content-Type", "application/warc-fields"), ("WARC-Filename", name)], b"format: WARC File Format 1.1\r\n"))
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    f.write(transaction(*row[:5], row[5], row[6]))
                    n += 1
        if n:
            out.move(temp, f"{home}/{name}")
            yield pa.RecordBatch.from_pydict({"name": pa.array([name])})
        else:
            out.delete_file(temp)

    return sorted(r["name"] for r in ready.mapInArrow(archive, "name string").collect())


def is_small(first: DataFrame) -> bool:
    """Whether the table of shared payloads has few enough bytes to be sent to every executor; else it is joined."""
    size = F.coalesce(F.octet_length("first_url"), F.lit(0)) + 120
    return (first.agg(F.sum(size)).first()[0] or 0) <= MOST_BROADCAST


def parse(stream, with_payload: bool):
    """The records of an archive, from a binary stream of gzip members."""
    z, head, raw = zlib.decompressobj(31), bytearray(), stream.read(1 << 20)
    while raw or head:
        if not raw:
            raw = stream.read(1 << 20)
            if not raw:
                return
        head += z.decompress(raw)
        raw = z.unused_data if z.eof else stream.read(1 << 20)
        if not z.eof:
            continue
        z = zlib.decompressobj(31)
        data, head = bytes(head), bytearray()
        top, _, rest = data.partition(b"\r\n\r\n")
        lines = top.decode().split("\r\n")[1:]
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        block = rest[: int(fields["content-length"])]
        kind = fields["warc-type"]
        own: dict = {}
        body = None
        if kind == "response":
            body = block.partition(b"\r\n\r\n")[2]
        elif kind == "metadata":
            own = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
        yield {
            "record_id": fields["warc-record-id"], "type": kind, "uri": fields.get("warc-target-uri"), "date": fields["warc-date"], "concurrent_to": fields.get("warc-concurrent-to"), "refers_to": fields.get("warc-refers-to"), "declared_digest": fields.get("warc-payload-digest"), "fields": own,
            "payload_bytes": None if body is None else len(body), "payload_digest": None if body is None else hashlib.sha256(body).hexdigest(),
        } | ({"payload": body} if with_payload else {})


def read_records(spark: SparkSession, folder: str, names: list[str], with_payload: bool = False) -> DataFrame:
    """One row per record of the archives; payloads only on request, else their lengths and digests."""
    kinds = [("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("declared_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    shape = pa.schema(kinds + ([("payload", pa.binary())] if with_payload else []))

    def rows(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    held, size = [], 0
                    for r in parse(f, with_payload):
                        held.append(r | {"fields": list(r["fields"].items())})
                        size += len(r.get("payload") or b"")
                        if len(held) >= 4096 or size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, shape)
                            held, size = [], 0
                    yield pa.RecordBatch.from_pylist(held, shape)

    files = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names)))
    return files.mapInArrow(rows, _RECORD + (", payload binary" if with_payload else ""))


def assemble(records: DataFrame) -> DataFrame:
    """capture_id, request, response, metadata: one nested row per response or revisit record."""
    def side(kind: str) -> DataFrame:
        own = F.struct("record_id", "uri", "date", "fields")
        return records.filter((F.col("type") == kind) & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.first(own).alias(kind))

    main = records.filter(F.col("type").isin("response", "revisit"))
    body = F.struct(*(c for c in main.columns if c not in ("concurrent_to", "fields")))
    captures = main.select(F.col("record_id").alias("capture_id"), body.alias("response"))
    return captures.join(side("request"), "capture_id", "left").join(side("metadata"), "capture_id", "left").select("capture_id", "request", "response", "metadata")


def resolve(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit's payload is that of its response."""
    flat = captures.select("capture_id", F.col("metadata.fields")["page-id"].cast("long").alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("first"), F.col("response.payload_bytes").alias("own_bytes"), F.col("response.payload_digest").alias("own_digest"))
    known = flat.filter("record_type = 'response'").groupBy(F.col("capture_id").alias("first")).agg(F.first("page_id").alias("refers_to"), F.first("own_bytes").alias("first_bytes"), F.first("own_digest").alias("first_digest"))
    responses = flat.filter("record_type = 'response'").select("page_id", F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = flat.filter("record_type = 'revisit'").join(known, "first", "left").select("page_id", F.col("first_bytes").alias("payload_bytes"), F.col("first_digest").alias("payload_digest"), "record_type", "refers_to")
    return responses.unionByName(revisits)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the pages written as archives in the shared folder, read back and assembled."""
    folder = shared_dir(spark, "warc")
    names = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    records = written(read_records(spark, folder, names), "warc-records")  # each side of the joins reads it
    return resolve(assemble(records))


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""

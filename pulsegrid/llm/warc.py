"""WARC archives, index first.

Tasks write a gzip member per record and return one index row per record: file, offset, length, URL and digest. The
stored index decides which files count: a task that is repeated writes under a new name, and files that no index row
names are never read. Reading selects index rows, sorts them by place, coalesces neighbours into byte ranges and
reads only those.

Of records with equal payloads of at least ``LEAST_BYTES`` bytes that of the largest page id is a response and the
others revisit it; only ids and digests are grouped for that. Pages travel once, keyed by id, so neither a hot host nor a page that
thousands copy meets in one task. Null html is an empty payload, a null URL an empty one; rows that repeat are records of
their own (equal ones of the largest id are all responses). An empty table writes an empty index. Other columns
do not matter. Files are written through pyarrow's file systems: local or shared mounts, HDFS and object stores.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scratch import materialize, scratch_root

LEAST_BYTES = 1000
#: A task starts another file beyond so many bytes.
FILE_BYTES = 256 << 20
#: Neighbours are read together across gaps up to GAP_BYTES, in ranges up to RANGE_BYTES (longer records alone).
GAP_BYTES, RANGE_BYTES = 64 << 10, 8 << 20

INDEX = ("file string, offset long, length long, url string, payload_digest string, payload_bytes long, record_type string, "
         "page_id long, refers_to long")
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else "file://" + os.path.abspath(uri))


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages with payload, digest, size and, for revisits, the page they refer to."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    wide = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    wide = wide.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    slim = wide.where(F.col("payload_bytes") >= LEAST_BYTES).select("page_id", "payload_digest")
    last = slim.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
    shared = last.where(F.col("refers_to") > F.coalesce(F.col("least"), F.lit(-1 << 63).cast("long"))).select("payload_digest", "refers_to")
    # Salted, since a third of all rows may have one digest.
    salts = 32
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    revisits = slim.dropDuplicates().withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(
        salted, ["payload_digest", "salt"]).where(F.col("page_id") < F.col("refers_to"))
    marks = revisits.select(F.col("page_id").alias("revisit_id"), F.col("payload_digest").alias("revisit_digest"), "refers_to")
    return wide.join(marks, (F.col("page_id") == F.col("revisit_id")) & (F.col("payload_digest") == F.col("revisit_digest")), "left").select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to")


def _member(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member holding a record."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url, safe=_URI)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is None:
        body += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    data = "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


_URI = "%:/?#[]@!$&'()*+,;=-._~"


def parse_member(data: bytes) -> dict:
    """The record of one gzip member."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[:int(fields["Content-Length"])]
    page = fields["WARC-Record-ID"][len("<urn:page:"):-1]
    response = fields["WARC-Type"] == "response"
    payload = body.partition(b"\r\n\r\n")[2] if response else None
    if response and hashlib.sha1(payload).hexdigest() != fields["WARC-Payload-Digest"][5:]:
        raise ValueError(f"payload of page {page} is damaged")
    return {
        "page_id": int(page) if page else None, "url": fields["WARC-Target-URI"], "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"][5:], "record_type": fields["WARC-Type"],
        "refers_to": None if response else int(fields["WARC-Refers-To"][len("<urn:page:"):-1]), "payload": payload,
    }


def write_archives(pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Write all pages below ``folder`` (by default one of its own in the shared scratch folder); returns the stored index."""
    folder = folder or f"{scratch_root(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = []
                for r in batch.slice(start, 512).to_pylist():
                    data = _member(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["refers_to"])
                    if out is None or at + len(data) > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(data)
                    rows.append({"file": name, "offset": at, "length": len(data), "url": r["url"], "payload_digest": r["payload_digest"],
                                 "payload_bytes": r["payload_bytes"], "record_type": "response" if r["refers_to"] is None else "revisit",
                                 "page_id": r["page_id"], "refers_to": r["refers_to"]})
                    at += len(data)
                yield pa.RecordBatch.from_pylist(rows, _INDEX_SCHEMA)
        if out is not None:
            out.close()

    index = plan_records(pages, **columns).mapInArrow(write, INDEX)
    return materialize(index.withColumn("file", F.concat(F.lit(folder + "/"), "file")))


_INDEX_SCHEMA = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()),
])
_RECORD_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


def byte_ranges(index: DataFrame, gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> DataFrame:
    """Sorted neighbours of a file as ranges: ``file``, ``start``, ``size`` and ``members``, the records inside.

    Files are cut into stretches of ``most`` bytes first, so that a range never needs more than one stretch in a task.
    """
    stretch = Window.partitionBy("file", "stretch").orderBy("offset")
    placed = index.select("file", "offset", "length", F.floor(F.col("offset") / most).alias("stretch"))
    ahead = F.lag(F.col("offset") + F.col("length")).over(stretch)
    split = placed.withColumn("opens", F.when(F.col("offset") - ahead <= gap, 0).otherwise(1))
    numbered = split.withColumn("range", F.sum("opens").over(stretch))
    return numbered.groupBy("file", "stretch", "range").agg(
        F.min("offset").alias("start"), (F.max(F.col("offset") + F.col("length")) - F.min("offset")).alias("size"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("members"))


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that index rows name; responses are checked against their digests while they are read."""
    schema = RECORD if payloads else RECORD.replace(", payload binary", "")
    arrow = _RECORD_SCHEMA if payloads else pa.schema(list(_RECORD_SCHEMA)[:-1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, object] = ("", None)
        for batch in batches:
            for r in batch.to_pylist():
                if held[0] != r["file"]:
                    system, path = _open(r["file"])
                    held = (r["file"], system.open_input_file(path))
                held[1].seek(r["start"])
                data = held[1].read(r["size"])
                found = []
                for m in r["members"]:
                    at = m["offset"] - r["start"]
                    record = parse_member(data[at:at + m["length"]])
                    if not payloads:
                        record.pop("payload")
                    found.append(record)
                    if len(found) == 512:
                        yield pa.RecordBatch.from_pylist(found, arrow)
                        found = []
                if found:
                    yield pa.RecordBatch.from_pylist(found, arrow)

    return byte_ranges(index).mapInArrow(read, schema)

"""WARC archives: written with an index, read back by coalesced byte ranges.

Every task writes the records of its rows into archives of its own (one gzip member a record) and
gives an index row a record: file, offset, length, URL, payload digest. The index is committed by
Spark, the archives carry a random name: what a lost attempt wrote is in no index and is cleared once the
index is whole. A reader takes any rows of the index, brings those of a file together in the order of
their offsets (a range partitioning of index rows, which are narrow), joins ranges that lie close into one
read and parses the records. Archives are opened through pyarrow's file systems at the folder's own URI.

Of records with equal payloads (by SHA-256; at least ``least_bytes``) the one with the largest id is a
response and the others are revisits that refer to it.

Defined cases: null payload counts as empty; a null or empty URL is written as urn:none and read as
null; white space in a URL is percent-encoded; a null id is never the response of a group that has
another id; rows that repeat the response's id are responses too, whose record ids are then alike; an empty table writes no archive and
an empty index; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.llm.common import join_by_key, scratch, table, written

INDEX = "file string, offset bigint, length bigint, url string, payload_digest string, id bigint, record_type string"
RECORD = "id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"
#: Bytes after which a task begins another archive; bytes between two ranges that are read over; bytes of a read.
ARCHIVE_BYTES, GAP, READ_BYTES = 1 << 28, 1 << 16, 1 << 23
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(ident, digest: str) -> str:
    return f"<urn:x-page:{'' if ident is None else ident}:{digest}>"


def _id_of(record_id: str):
    found = re.match(r"<urn:x-page:(-?\d*):", record_id)
    return int(found[1]) if found and found[1] else None


def record(ident, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record; a revisit has the HTTP header of its payload, whose length it states, and no body."""
    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "urn:none"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(ident, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record; raises ValueError where it isn't whole or its payload doesn't fit its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    stated = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
    if not revisit and (payload_digest(payload) != digest or len(payload) != stated):
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't fit its digest")
    url = fields["warc-target-uri"]
    return {"id": _id_of(fields["warc-record-id"]), "url": None if url == "urn:none" else url, "record_type": fields["warc-type"], "refers_to": _id_of(fields["warc-refers-to"]) if revisit else None, "payload_bytes": stated, "payload_digest": digest, "payload": None if revisit else payload}


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for ident, url, html, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    payload = (html or "").encode("utf-8", "replace")
                    digest = payload_digest(payload)
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = pack.compress(record(ident, url, payload, digest, refers_to, revisit)) + pack.flush()
                    out.write(raw)
                    rows.append({"file": name, "offset": at, "length": len(raw), "url": url, "payload_digest": digest, "id": ident, "record_type": "revisit" if revisit else "response"})
                    at += len(raw)
                schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("id", pa.int64()), ("record_type", pa.string())])
                yield pa.RecordBatch.from_pylist(rows, schema)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> tuple[str, DataFrame]:
    """Writes a record a row below folder (one of our own in the shared folder by default); gives folder and index."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(f"{root}/archives", recursive=True)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    pages = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    groups = pages.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("id").alias("stays"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND stays IS NOT NULL")
    groups = written(groups, "payload-groups")
    rows = join_by_key(pages, groups, ["digest"], "n", pages.count(), "left")  # the only shuffle of payloads
    revisit = F.col("stays").isNotNull() & ~F.col("id").eqNullSafe(F.col("stays"))
    rows = rows.select("id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("stays")).alias("refers_to"))
    rows.mapInArrow(_writer(f"{folder}/archives"), INDEX).write.parquet(f"{folder}/index")
    index = read_index(spark, folder)
    clear_lost(index, folder)
    return folder, index


def clear_lost(index: DataFrame, folder: str) -> int:
    """Deletes archives that no row of the index names (of lost attempts of tasks); gives their number.
    As many names reach the driver as there are archives."""
    store, root = fs.FileSystem.from_uri(f"{folder}/archives")
    named = {r["file"] for r in index.select("file").distinct().toLocalIterator()}
    lost = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.base_name not in named]
    for path in lost:
        store.delete_file(path)
    return len(lost)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def ranges(places: Iterable[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Reads (file, begin, end, [(offset, length)]) that cover places (file, offset, length), which come by
    file and offset. A read ends at READ_BYTES, so what is held is bounded however many places there are."""
    held: list = []
    for name, offset, length in places:
        if held and (name != held[0] or offset > held[2] + GAP or offset + length - held[1] > READ_BYTES):
            yield tuple(held)
            held = []
        if not held:
            held = [name, offset, offset, []]
        held[2] = max(held[2], offset + length)
        held[3].append((offset, length))
    if held:
        yield tuple(held)


def read_records(selected: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that rows of an index name, whole (payload null for revisits) or without payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(f"{folder}/archives")
        names = ["id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *(["payload"] if payloads else [])]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        opened, name = None, None
        places = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for file, begin, end, members in ranges(places):
            if file != name:
                if opened is not None:
                    opened.close()
                opened, name = store.open_input_file(f"{root}/{file}"), file
            raw = opened.read_at(end - begin, begin)
            found = [parse(zlib.decompress(raw[offset - begin : offset - begin + length], 31)) for offset, length in members]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in zip(names, kinds, strict=False)], names)
        if opened is not None:
            opened.close()

    together = selected.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return together.mapInArrow(run, RECORD + (", payload binary" if payloads else ""))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = write_archives(table(spark, sf_dir, "pages"))
    found = read_records(index, folder, payloads=False).withColumnRenamed("id", "page_id")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
     g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS stays FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + (((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = stays THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> stays THEN stays END AS refers_to
FROM g
"""

"""Exact dedup with a log-structured merge index of digests.

Each task keeps a memtable of digests; a full one is flushed as sorted runs, one for each digest
range, with a Bloom filter. Compaction merges the runs of a range and keeps, of equal digests, the
identifier that stays and the number of rows. Documents whose digest occurs more than once (hits) are
compared byte by byte with the document that stays; what differs is grouped by its bytes.

Defined cases: null text counts as empty, all empty texts are equal; a null id loses every tie; rows
that repeat an id are rows of their own, and of those that repeat the id that stays (or are null with
it) the longest, then the first one read stays, so every group keeps exactly one row (with different
bytes under one digest, which only tests can provoke, all rows of that id); an empty table gives no
rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.llm.common import SLICE_BYTES, WHITESPACE, join_by_key, slices, table, utf8, written

NO_ID = np.iinfo(np.int64).max
FIELDS = ("n_chars", "ids", "rows", "counts")
RUN = "range int, digests binary, n_chars binary, ids binary, rows binary, counts binary, filter binary"
ENTRY = "digest binary, keep_id bigint, keep_row bigint, n_rows bigint"
#: Bits of the broadcast filter of hits: 10 a hit, this many at most (8 MB).
MOST_FILTER_BITS = 1 << 26


def normal_form(text: bytes) -> bytes:
    return text.translate(None, WHITESPACE)


class Bloom:
    """A filter of 16 bits a digest and four probes taken from the digest itself."""

    def __init__(self, words: np.ndarray, bits: np.ndarray | None = None):
        if bits is None:
            size = 1 << max(6, int(np.ceil(np.log2(max(1, len(words)) * 16))))
            bits = np.zeros(size, bool)
            for k in range(4):
                bits[words[:, k] & np.uint64(size - 1)] = True
        self.bits = bits

    def may_hold(self, words: np.ndarray) -> np.ndarray:
        mask, out = np.uint64(len(self.bits) - 1), np.ones(len(words), bool)
        for k in range(4):
            out &= self.bits[words[:, k] & mask]
        return out

    def pack(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> Bloom:
        return cls(None, np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool))


class Run:
    """Entries sorted by digest: who stays (most characters, then the smallest id, then the first row) and
    how many rows."""

    def __init__(self, words, n_chars, ids, rows, counts):
        order = np.lexsort((rows, ids, -n_chars, words[:, 3], words[:, 2], words[:, 1], words[:, 0]))
        words, counts = words[order], counts[order]
        first = np.ones(len(ids), bool)
        first[1:] = (words[1:] != words[:-1]).any(axis=1)
        at = np.flatnonzero(first)
        self.words, self.n_chars, self.ids, self.rows = words[at], n_chars[order][at], ids[order][at], rows[order][at]
        self.counts = np.add.reduceat(counts, at) if len(at) else counts

    @classmethod
    def of(cls, words, **fields) -> Run:
        """A run of entries that are sorted and distinct already."""
        out = object.__new__(cls)
        out.words = words
        vars(out).update(fields)
        return out

    def part(self, at) -> Run:
        return Run.of(self.words[at], **{k: getattr(self, k)[at] for k in FIELDS})


def merge(a: Run, b: Run, b_filter: Bloom) -> Run:
    """Compaction of two runs: only entries that the filter lets through are looked for in the other run."""
    maybe = b_filter.may_hold(a.words)
    at = np.searchsorted(b.words[:, 0], a.words[:, 0], "left")
    at = np.minimum(at, max(0, len(b.ids) - 1))
    hit = maybe & (len(b.ids) > 0)
    if hit.any():
        hit &= b.words[at, 0] == a.words[:, 0]
    both = [np.concatenate([getattr(a, k), getattr(b, k)]) for k in ("words", *FIELDS)]
    if hit.any():
        return Run(*both)
    words = both[0]  # disjoint runs are only interleaved
    order = np.lexsort((words[:, 3], words[:, 2], words[:, 1], words[:, 0]))
    return Run.of(words[order], **{k: x[order] for k, x in zip(FIELDS, both[1:], strict=True)})


def _manifest(digest_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            n, digests = [], []
            for part in slices(batch, "text"):
                for text in _texts(part):
                    n.append(len(text.decode("utf-8", "replace")))
                    digests.append(_digest(normal_form(text), digest_bytes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(np.arange(row, row + len(n)))], ["id", "n_chars", "digest", "row"])
            row += len(n)

    return run


def _texts(part: pa.RecordBatch) -> Iterator[bytes]:
    """The texts (column 1) of a slice as UTF-8, null as empty."""
    raw, offsets = utf8(part.column(1))
    view = raw.tobytes()
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield view[s:e]


def _digest(text: bytes, digest_bytes: int) -> bytes:
    return hashlib.sha256(text).digest()[:digest_bytes].ljust(32, b"\0")


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 4)


def _flush(ranges: int, memtable_rows: int):
    def flush(parts: list) -> pa.RecordBatch:
        run = Run(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        cut = np.searchsorted(run.words[:, 0], np.array([(k << 64) // ranges for k in range(ranges)], np.uint64))
        rows = []
        for k, (s, e) in enumerate(zip(cut, [*cut[1:], len(run.ids)], strict=True)):
            if s < e:
                x = run.part(slice(s, e))
                rows.append({"range": k, "digests": x.words.astype(">u8").tobytes(), **{f: getattr(x, f).tobytes() for f in FIELDS}, "filter": Bloom(x.words).pack()})
        return pa.RecordBatch.from_pylist(rows, pa.schema([("range", pa.int32()), *((k, pa.binary()) for k in ("digests", *FIELDS, "filter"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)
                parts.append((_words(batch.column(2)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), ids, batch.column(3).to_numpy(), np.ones(len(ids), np.int64)))
                held += len(ids)
            if held >= memtable_rows:
                yield flush(parts)
                parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def _compact(rows: pa.Table) -> pa.Table:
    level = []
    for r in rows.to_pylist():
        words = np.frombuffer(r["digests"], ">u8").astype(np.uint64).reshape(-1, 4)
        level.append((Run.of(words, **{k: np.frombuffer(r[k], np.int64) for k in FIELDS}), Bloom.unpack(r["filter"])))
    while len(level) > 1:  # merge neighbours of like size, level by level
        level.sort(key=lambda x: len(x[0].ids))
        merged = [merge(a, b, f) for (a, _), (b, f) in zip(level[::2], level[1::2], strict=False)]
        level = [(x, Bloom(x.words)) for x in merged] + (level[-1:] if len(level) % 2 else [])
    run = level[0][0]
    run = run.part(np.flatnonzero(run.counts > 1))
    raw = run.words.astype(">u8").tobytes()
    keep = pa.array(run.ids, pa.int64(), mask=run.ids == NO_ID)
    return pa.table({"digest": pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()), "keep_id": keep, "keep_row": pa.array(run.rows, pa.int64()), "n_rows": pa.array(run.counts, pa.int64())})


def _hit_filter(index: DataFrame) -> np.ndarray:
    """A bitmap over the digests of hits, of MOST_FILTER_BITS at most; its words are OR-ed before they reach the driver."""
    bits = 1 << 10
    while bits < min(10 * index.count(), MOST_FILTER_BITS):
        bits *= 2
    place = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("bigint") % bits
    words = index.select(place.alias("at")).groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["word"]] = r["bits"]
    return out


def _candidates(filter_words: np.ndarray, digest_bytes: int):
    """Normal forms of documents that may be hits; equal ones of a batch become one row with all their ids.
    Texts are read, and forms handed on, about SLICE_BYTES at a time; only distinct forms are held for a batch."""

    def rows(found: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.binary()), pa.array([k[1] for k in found], pa.binary()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["digest", "form", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = len(filter_words) * 64
        for batch in batches:
            found = {}
            for part in slices(batch, "text"):
                for ident, text in zip(part.column(0).to_pylist(), _texts(part), strict=True):
                    form = normal_form(text)
                    digest = _digest(form, digest_bytes)
                    place = int.from_bytes(digest[:7], "big") % bits
                    if int(filter_words[place // 64]) >> (place % 64) & 1:
                        found.setdefault((digest, form), []).append(ident)
            while found:
                some, size = {}, 0
                while found and size < SLICE_BYTES:
                    key, ids = found.popitem()
                    some[key] = ids
                    size += len(key[1])
                yield rows(some)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = 1 << 17, range_rows: int = 1 << 19, digest_bytes: int = 32) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, digest (of the normal form).

    memtable_rows: rows a task gathers before it flushes. range_rows: rows a digest range holds at
    most when digests are spread evenly, which bounds what one compaction has in memory.
    digest_bytes: fewer than 32 only to provoke collisions in tests.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    manifest = written(docs.mapInArrow(_manifest(digest_bytes), "id bigint, n_chars bigint, digest binary, row bigint"), "manifest")
    total = manifest.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // range_rows + 1)
    runs = manifest.mapInArrow(_flush(ranges, memtable_rows), RUN)
    index = written(runs.groupBy("range").applyInArrow(_compact, ENTRY), "index")
    bitmap = spark.sparkContext.broadcast(_hit_filter(index))
    read = docs.mapInArrow(lambda it, b=bitmap, n=digest_bytes: _candidates(b.value, n)(it), "digest binary, form binary, ids array<bigint>")
    seen = written(read.join(index, "digest"), "hits")
    stays = seen.filter(F.coalesce(F.array_contains("ids", F.col("keep_id")), F.col("keep_id").isNull() & F.exists("ids", lambda x: x.isNull())))
    stays = stays.groupBy("digest").agg(F.max("form").alias("kept_form"))
    wrong = written(seen.join(stays, "digest").filter(F.col("form") != F.col("kept_form")).select("digest", "form", "ids"), "collisions")
    result = join_by_key(manifest, index, ["digest"], "n_rows", total, "left").select("id", "n_chars", "digest", (F.col("n_rows").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"), F.when(F.col("n_rows").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n_rows", F.lit(1)).alias("n_rows"))
    if not wrong.isEmpty():  # different bytes under one digest: their groups are made by the bytes
        rows = wrong.select("digest", "form", F.explode("ids").alias("id")).join(manifest.select("id", "n_chars").distinct(), "id")
        own = rows.groupBy("digest", "form").agg(F.min(F.struct(-F.col("n_chars"), F.col("id"))).alias("best"), F.count(F.lit(1)).alias("own_rows"))
        fixed = rows.join(own, ["digest", "form"]).select("id", "digest", F.col("best.id").alias("own_keep"), "own_rows").distinct()
        lost = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
        result = (result.join(lost, "digest", "left").join(fixed, ["id", "digest"], "left")
                  .withColumn("keep_id", F.coalesce("own_keep", "keep_id"))
                  .withColumn("n_rows", F.coalesce("own_rows", F.col("n_rows") - F.coalesce("lost", F.lit(0))))
                  .withColumn("kept", F.when(F.col("own_keep").isNull() & F.col("lost").isNull(), F.col("kept")).otherwise(F.col("id").eqNullSafe(F.col("keep_id")))))
    return result.select("id", "keep_id", F.col("n_rows").cast("bigint").alias("group_size"), "kept", "digest")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
     g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

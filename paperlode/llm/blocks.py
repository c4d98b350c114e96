"""Texts packed into blocks, in a table bucketed by block, so that joins by block leave texts in place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.llm.common import scratch, table_name, utf8

#: Bytes of text in a block; more only if one text has more.
BLOCK_BYTES = 1 << 22
NO_ID = np.iinfo(np.int64).max
SCHEMA = "block bigint, n_bytes bigint, ids binary, known binary, ends binary, text binary"


def _pack_blocks(block_bytes: int):
    schema = pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("ends", pa.binary()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def pack() -> pa.RecordBatch:
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            numbers = np.array([NO_ID if i is None else i for i in ids], np.int64)
            known = np.array([i is not None for i in ids], np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([held], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (numbers, known, ends)), pa.array([b"".join(texts)], pa.binary())], schema=schema)

        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for i, s, e in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if texts and held + e - s > block_bytes:
                    yield pack()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(i)
                texts.append(raw[s:e].tobytes())
                held += e - s
        if texts:
            yield pack()

    return run


def blocked(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """The blocks of docs, as many buckets as there are shuffle partitions, and where they lie. Null text counts as empty."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = docs.mapInArrow(_pack_blocks(block_bytes), SCHEMA).write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
    path = scratch(spark, "blocks")
    out.option("path", path).option("compression", "zstd").saveAsTable(table_name(path))
    return spark.table(table_name(path)), path


def total_bytes(blocks: DataFrame) -> int:
    """Bytes of text in all blocks; reads one narrow column."""
    return blocks.agg(F.sum("n_bytes")).first()[0] or 0


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids (NO_ID for null), whether known, where each text ends, and the bytes of all."""
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], np.uint8), np.frombuffer(row["ends"], np.int64), np.frombuffer(row["text"], np.uint8)

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters of ``[\x20\x09-\x0D]``.
WHITESPACE = b" \t\n\x0b\x0c\r"
#: UTF-8 bytes of text handed to numpy at a time; bounds the memory of a Python worker.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a folder of our own is made
    under a local master; on a cluster a machine's own folder would split the data, so that is an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='paperlode-')}"
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table_name(path: str) -> str:
    """The catalogue's name of a table of ours that lies at path."""
    return path.rpartition("/")[2].replace("-", "_")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again; cuts the lineage."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As written(), with the path, for tables that are discarded before the job ends."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def buckets_for(spark: SparkSession, n_bytes: int, per_partition: int, bucket_bytes: int = 1 << 25) -> tuple[int, int]:
    """(hash buckets, partitions) for n_bytes of rows: a bucket, which one call holds in memory, has about
    bucket_bytes at most and a task 2 * bucket_bytes, however large the input; small inputs have
    per_partition buckets a shuffle partition."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // (2 * bucket_bytes)))
    return max(per_partition * parts, -(-n_bytes // bucket_bytes)), parts


#: One key's rows are joined by a broadcast instead of a shuffle from this share of all rows on (and HOT_ROWS).
HOT_SHARE, HOT_ROWS = 4096, 64


def join_by_key(rows: DataFrame, per_key: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with per_key (one row a key, of whose column size says how many rows have it), hot keys apart.

    Keys of over total / HOT_SHARE rows are fewer than HOT_SHARE, so their part of per_key is broadcast and
    their rows stay where they are; no other key can fill a task. rows without a key in per_key go, or stay with
    how = "left"; per_key then has no key that rows lack."""
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(per_key.filter(F.col(size) > limit))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(per_key.filter(F.col(size) <= limit), keys, how)
    return rest.unionByName(rows.join(hot, keys).select(*rest.columns))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of ours in the shared folder that nothing will read again, and its catalogue entry."""
    spark.sql(f"DROP TABLE IF EXISTS `{table_name(path)}`")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def bucketed(df: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """df written as a table bucketed by key, one file a bucket, and the same rows read without the buckets.

    A join of the table by its key doesn't move it again. AQE splits hot keys only where both sides are
    shuffled, so a join whose other side may have one takes the plain rows."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, name)
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).option("compression", "zstd").saveAsTable(table_name(path))
    return spark.table(table_name(path)), spark.read.schema(df.schema).parquet(path)


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with place, their number (from 0) in the given order, written to the shared folder.

    order must tell any two rows apart, so that range partitions are even whatever keys are hot. A row's
    number is what the partitions before its own hold and its place inside; only the partitions' counts,
    one row each, meet in one task."""
    held = written(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), name)
    part = F.shiftright("place", 33)
    counts = held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    held = held.withColumn("part", part).join(F.broadcast(before), "part")
    return held.withColumn("place", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out_column(id_col: str = "doc_id"):
    """True for documents whose crc32 of the id as text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows with about ``most`` bytes of text each; one text is never cut."""
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of 64-bit words (in place on a fresh array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of many runs, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)

"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows of a source are ranked in a seeded random order; all rows are sorted by fractional rank,
(rank - 1 + offset) / rows of the source, and the sorted sequence is cut into shards of equal row counts
(law "rows": counts at most one apart), so every shard has the mixture of the whole. The offset is a
seeded hash of the source in (0, 1), which spreads sources of few rows over all shards.

Both orders are made by a range-partitioned sort whose last key is a number of the row's own, so however
hot a source, an id or a fractional rank is, no task gets more than its share; ranks follow from the
partitions' counts (common.ranked).

Defined cases: null text has no bytes (size 1, crc32 0); a null source is a source of its own; a null
id hashes as the text "null"; equal texts are sharded one by one (a group may exceed a shard, and the
mixture binds rows, not groups); rows that repeat an id each get a place (those with the same text are
alike, so which has which place is left to the order they are read in); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.llm.common import join_by_key, ranked, table, written


def _uniform(h):
    """52 bits of an md5 as a number in (0, 1)."""
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def shard_documents(docs: DataFrame, shards: int = 16, seed: str = "shard-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: id, source, size, text_crc32, frac_rank, position, shard, slot."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), source.alias("src"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(F.concat_ws(":", F.lit(seed), ident)).alias("h"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    alike = ["id", "text_crc32", "size", "row"]
    placed = ranked(rows, ["src", "h", *alike], "shard-ranks").withColumnRenamed("place", "src_place")
    total = rows.count()
    sources = written(placed.groupBy("src").agg(F.min("src_place").alias("src_first"), F.count(F.lit(1)).alias("src_rows")), "shard-sources")
    offset = _uniform(F.md5(F.concat_ws(":", F.lit(seed), F.lit("source"), F.col("src"))))
    frac = (F.col("src_place") - F.col("src_first") + offset) / F.col("src_rows")
    placed = join_by_key(placed, sources, ["src"], "src_rows", total).select("id", "src", "size", "text_crc32", "h", "row", frac.alias("frac_rank"))
    placed = ranked(placed, ["frac_rank", "src", "h", *alike], "shard-places").withColumnRenamed("place", "position")
    shard = F.expr(f"cast((position * {shards}) div {max(1, total)} as int)")
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select("id", F.expr("if(src = 'n', null, substring(src, 2))").alias("source"), "size", "text_crc32", "frac_rank", "position", "shard", (F.col("position") - first).cast("bigint").alias("slot"))


def op8_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")

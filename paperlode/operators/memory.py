"""Working memory: append-only logs of observations, findings, reviews and calls; the latest row of a key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("lead", "hypothesis", "question", "note", "dead_end", "connection")
STATUSES = ("open", "confirmed", "refuted", "closed")
OPEN_KINDS = ("lead", "hypothesis", "question")


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key: one aggregate, so rows of a key meet after they are thinned out."""
    whole = F.struct(*(F.col(c) for c in log.columns))
    newest = log.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("newest"))
    return newest.select("newest.*")


def list_observations(observations: DataFrame, status: str | None = None, kind: str | None = None, entity: str | None = None, k: int | None = 50) -> DataFrame:
    """Newest first; entity is looked for in the row's entity ids."""
    rows = observations
    if status:
        rows = rows.filter(F.col("status") == status)
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    if entity:
        rows = rows.filter(F.exists("entity_ids", lambda e: e.contains(entity)))
    rows = rows.orderBy(F.desc("updated_at"), F.desc("id"))
    return rows if k is None else rows.limit(k)


def open_threads(observations: DataFrame, k: int = 10) -> DataFrame:
    return observations.filter((F.col("status") == "open") & F.col("kind").isin(*OPEN_KINDS)).orderBy(F.desc("updated_at"), F.desc("id")).limit(k)


def recall(items: DataFrame, query: str, k: int = 8, text_col: str = "text") -> DataFrame:
    """items(id, source, text) by how many distinct words of the query they hold; those with none go."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    rows = items.withColumn("score", F.size(F.array_intersect(words(F.col(text_col)), words(F.lit(query)))).cast("double"))
    return rows.filter("score > 0").orderBy(F.desc("score"), "source", "id").limit(k)


def recall_vectors(items: DataFrame, query: str, k: int = 8, embedder_name: str = "hashing") -> DataFrame:
    """items(id, source, text) by cosine with the query."""
    from paperlode.operators.vectors import embed_chunks, embedder, nearest

    vectors = embed_chunks(items.select(F.concat_ws("\x1f", "source", "id").alias("chunk_id"), "text", F.lit("").alias("title")), embedder_name)
    q = items.sparkSession.createDataFrame([([float(x) for x in embedder(embedder_name)([query])[0]],)], "q array<float>")
    best = nearest(vectors, q, k)
    return best.select(F.split("id", "\x1f")[1].alias("id"), F.split("id", "\x1f")[0].alias("source"), "score")


def tail(log: DataFrame, n: int = 20) -> DataFrame:
    """The last n rows of a trace, oldest of them first."""
    return log.orderBy(F.desc("at"), F.desc("id")).limit(n).orderBy("at", "id")

"""Whole documents within a token budget, and samples of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.functions.columns import citation_token, token_estimate


def read_documents(documents: DataFrame, doc_ids: list[str], budget: int = 16_000, factor: float = 0.75) -> DataFrame:
    """doc_id, place, approx_tokens, status (read, token_budget, unknown), text and whole-document token of asked ids.

    Documents are taken in the order asked while they fit; one that doesn't is passed over and later,
    smaller ones may still fit; the first known one is always taken. The fold over the asked ids carries
    only ids and estimates."""
    spark = documents.sparkSession
    asked = spark.createDataFrame([(i, d) for i, d in enumerate(doc_ids)], "place int, doc_id string")
    docs = documents.withColumn("doc_id", F.col("doc_id").cast("string")).join(F.broadcast(asked), "doc_id")
    sizes = docs.select("place", F.greatest(F.lit(1), token_estimate("text", factor)).alias("est"))
    known = asked.join(sizes, "place", "left")
    kind = "array<struct<place:int,doc_id:string,est:int,status:string>>"
    taken = "x.est IS NOT NULL AND NOT (a.any AND a.used + x.est > %d)" % budget
    status = f"CASE WHEN x.est IS NULL THEN 'unknown' WHEN {taken} THEN 'read' ELSE 'token_budget' END"
    row = f"named_struct('place', x.place, 'doc_id', x.doc_id, 'est', x.est, 'status', {status})"
    zero = f"named_struct('used', 0, 'any', false, 'out', cast(array() as {kind}))"
    step = f"named_struct('used', a.used + IF({taken}, x.est, 0), 'any', a.any OR ({taken}), 'out', concat(a.out, cast(array({row}) as {kind})))"
    fold = f"aggregate(items, {zero}, (a, x) -> {step})"
    items = known.groupBy().agg(F.sort_array(F.collect_list(F.struct("place", "doc_id", "est"))).alias("items"))  # as many as were asked for
    plan = items.select(F.explode(F.expr(fold)["out"]).alias("r")).select("r.*")
    text = docs.select("place", "text", citation_token("doc_id", F.lit(0), F.length("text"), "text").alias("citation_token"))
    out = plan.join(text, "place", "left")
    kept = F.col("status") == "read"
    return out.select("doc_id", "place", F.col("est").alias("approx_tokens"), "status", F.when(kept, F.col("text")).alias("text"), F.when(kept, F.col("citation_token")).alias("citation_token")).orderBy("place")


def sample(documents: DataFrame, n: int = 200, order: str = "random", seed: int | None = None, where=None) -> DataFrame:
    """doc_id of a random or first draw."""
    rows = documents if where is None else documents.filter(where)
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"))
    return rows.orderBy(F.rand(seed) if order == "random" else F.col("doc_id")).limit(n)


def sample_ids(documents: DataFrame, n: int = 200, order: str = "random", seed: int | None = None, where=None) -> list[str]:
    """The ids of sample(), n of which reach the driver."""
    return [r["doc_id"] for r in sample(documents, n, order, seed, where).collect()]


def spread_sample(documents: DataFrame, n: int = 300, id_col: str = "doc_id") -> DataFrame:
    """About n rows spread evenly over the ids' hash order, so every source has its share."""
    total = documents.count()
    step = max(1, total // max(1, n))
    return documents.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(step)) == 0)

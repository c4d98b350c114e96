"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Every document draws a uniform number from a seeded hash of its id and inverts the Poisson
distribution whose mean is the repetition rate of its source. Documents are exploded by their count
and dealt to partitions by a second hash, in whose order the rows of a partition stand.

Defined cases: a null source is a source of its own; a null id hashes as the text "null"; rows that
repeat an id draw the same count; texts are carried as they are, null included; a source without a
target weight is left out; an empty table gives no rows; a column of the input named copy_no or
shuffle_key is replaced, all others are carried whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperlode.llm.common import table, written

#: The table of rates is broadcast up to this many sources and steps of all (8 MB), and joined by a shuffle beyond.
MOST_BROADCAST_SOURCES, MOST_BROADCAST_STEPS = 10_000, 1 << 20
SEED = "mix-1"


def uniform(*parts):
    """52 bits of an md5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_rates(docs: DataFrame, source_col: str, weights: dict | None, temperature: float, target_rows: int | None) -> DataFrame:
    """mix_source, rate, first, cdf: the Poisson distribution function from the count ``first`` on, where it
    begins to differ from 0, up to where it is 1. It has about 24 sqrt(rate) + 60 steps, summed once."""
    rows = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        rows = rows.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "mix_given string, weight double")
        rows = rows.join(given, F.col("mix_source").cast("string").eqNullSafe(F.col("mix_given"))).drop("mix_given")
    total = rows.agg(F.sum("n").alias("all_rows"), F.sum("weight").alias("all_weight"))
    goal = F.col("all_rows").cast("double") if target_rows is None else F.lit(float(target_rows))
    rate = rows.join(F.broadcast(total)).withColumn("rate", goal * F.col("weight") / F.col("all_weight") / F.col("n")).filter("rate > 0")  # one row
    rate = rate.withColumn("first", F.expr("cast(greatest(0D, floor(rate - 12 * sqrt(rate) - 30)) as bigint)"))
    steps = rate.select("mix_source", "rate", "first", F.explode(F.expr("sequence(first, cast(ceil(rate + 12 * sqrt(rate) + 30) as bigint))")).alias("k"))
    own = Window.partitionBy("mix_source", "rate", "first")
    upto = own.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("log_p", F.sum(F.when(F.col("k") > F.col("first"), F.ln(F.col("rate") / F.col("k"))).otherwise(0.0)).over(upto))
    steps = steps.withColumn("p", F.exp(F.col("log_p") - F.max("log_p").over(own)))  # against the likeliest count
    steps = steps.withColumn("c", F.sum("p").over(upto) / F.sum("p").over(own))
    found = steps.groupBy("mix_source", "rate", "first").agg(F.sort_array(F.collect_list(F.struct("k", "c"))).alias("steps"))  # bounded by the rate
    return found.select("mix_source", "rate", "first", F.transform("steps", lambda s: s["c"]).alias("cdf"))


def poisson_count(u, cdf, first):
    """How often a row with the uniform number u is drawn: the steps of the distribution function up to u,
    by binary search."""
    half = "cast((s.low + s.high) div 2 as int)"
    step = f"if(s.low >= s.high, s, if({cdf}[{half}] <= {u}, named_struct('low', {half} + 1, 'high', s.high), named_struct('low', s.low, 'high', {half})))"
    return F.expr(f"{first} + aggregate(sequence(1, 1 + cast(ceil(log2(size({cdf}) + 1)) as int)), named_struct('low', 0, 'high', size({cdf})), (s, i) -> {step}, s -> s.low)")


def mix_sources(docs: DataFrame, weights: dict | None = None, temperature: float = 0.5, target_rows: int | None = None, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The columns of docs, with copy_no (from 0) and shuffle_key, each row as often as it was drawn.

    weights: share of each source in the mixture; None takes the number of rows to the power of
    temperature. target_rows: expected rows of the mixture, None for as many as docs has.
    """
    docs = docs.drop("copy_no", "shuffle_key")
    rates = written(source_rates(docs, source_col, weights, temperature, target_rows), "rates")
    held = rates.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("cdf")), F.lit(0)).alias("steps")).first()
    small = held["n"] <= MOST_BROADCAST_SOURCES and held["steps"] <= MOST_BROADCAST_STEPS
    # the caller's columns travel in one struct, so none of their names can clash with ours
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col(id_col).cast("string").alias("ident"), F.col(source_col).alias("of"))
    rows = rows.withColumn("ident", F.coalesce("ident", F.lit("null")))
    drawn = rows.join(F.broadcast(rates) if small else rates, F.col("of").eqNullSafe(F.col("mix_source")))
    drawn = drawn.withColumn("u", uniform(F.lit(seed), F.col("ident"))).withColumn("n", poisson_count("u", "cdf", "first")).filter("n > 0")
    drawn = drawn.select("own", "ident", F.explode(F.expr("sequence(0, cast(n - 1 as int))")).alias("copy_no"))
    drawn = drawn.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("shuffle"), F.col("ident"), F.col("copy_no"))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return drawn.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key").select("own.*", "copy_no", "shuffle_key")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "text", "copy_no", "shuffle_key")


OP2_SQL = f"""
WITH s AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
     r AS (SELECT source, (SELECT sum(n) FROM s) * w / (SELECT sum(w) FROM s) / n AS rate FROM s),
     t AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM r, range(0, 120) AS x(k)),
     c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM t),
     d AS (SELECT *, ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
     m AS (SELECT d.doc_id, count(*) AS copies FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND c.cdf <= d.u GROUP BY d.doc_id)
SELECT d.doc_id, d.source, d.lang, d.text, x.k::INT AS copy_no, md5('{SEED}:shuffle:' || d.doc_id || ':' || x.k) AS shuffle_key
FROM d JOIN m USING (doc_id), range(0, m.copies) AS x(k)
"""

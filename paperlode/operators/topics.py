"""Topic clusters: k-means over vectors and TF-IDF labels over one text a cluster."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words without a topic (a short fixed list).
STOP_WORDS = tuple("a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in into is it its may more most no not of on or other our out over she should so some such than that the their them then there these they this to under up was we were what when which who will with would you your".split())


def auto_k(n: int) -> int:
    """Half the count's root, from 2 to 40, at most n."""
    return max(1, min(n, max(2, min(40, round(math.sqrt(n / 2))))))


def cluster_vectors(vectors: DataFrame, k: int | str = "auto", seed: int = 0, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster. A number of clusters is used as given, also as text; no vectors give no rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(F.col(id_col).alias("id"), array_to_vector(F.transform(F.col(vector_col), lambda x: x.cast("double"))).alias("features"))
    n = rows.count()
    kk = auto_k(n) if str(k) == "auto" else max(1, min(int(k), n))
    if kk == 1:
        return rows.select("id", F.lit(0).alias("cluster"))
    model = KMeans(k=kk, seed=seed, initSteps=5, maxIter=50).fit(rows)
    return model.transform(rows).select("id", F.col("prediction").alias("cluster"))


def cluster_terms(texts: DataFrame, k: int = 5, most: int = 2000, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """cluster, term, weight, place: the k heaviest terms of texts(cluster, text).

    Terms are words of two letters and more and pairs of them, without stop words; the ``most`` commonest
    ones over all clusters count. Weight: tf * (ln((1 + clusters) / (1 + df)) + 1), of length 1 a cluster."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*stop_words))
    rows = texts.select("cluster", words.alias("w"))
    pairs = F.expr("transform(sequence(1, greatest(size(w) - 1, 1)), i -> if(size(w) < 2, null, concat(w[i - 1], ' ', w[i])))")
    counts = rows.select("cluster", F.explode(F.concat("w", F.filter(pairs, lambda p: p.isNotNull()))).alias("term")).groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = counts.groupBy("term").agg(F.sum("tf").alias("all_tf"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("all_tf"), "term").limit(most)
    n = texts.select("cluster").distinct().agg(F.count(F.lit(1)).alias("n"))  # one row
    rows = counts.join(F.broadcast(vocabulary.select("term", "df")), "term").join(F.broadcast(n))  # most rows
    rows = rows.withColumn("raw", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norms = rows.groupBy("cluster").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    rows = rows.join(norms, "cluster").withColumn("weight", F.col("raw") / F.col("norm"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("weight", 9)), "term"))
    return rows.withColumn("place", place).filter(F.col("place") <= k).select("cluster", "term", "weight", "place")

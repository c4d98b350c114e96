"""Registered queries against their SQL on tables made here."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperlode.operators import linkage
from paperlode.plans import catalogue


def _both(spark, folder, name: str, **tables: pd.DataFrame) -> tuple[list, list]:
    """Sorted rows of a query and of its SQL over tables."""
    con = duckdb.connect()
    for t, df in tables.items():
        con.register("given", df)
        con.execute(f"COPY given TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(catalogue.ORACLE_SQL[name])
    got = catalogue.QUERIES[name](spark, str(folder)).select(*want.columns)
    return sorted(tuple(r) for r in got.collect()), sorted(want.fetchall())


def test_linear_peers_leave_out_zeros(spark, tmp_path):
    values = [10.0, 11.0, 12.5, 13.0, 14.0, 90.0, 0.0, 0.0, 0.0, -5.0]
    events = pd.DataFrame({"event_id": range(10), "user_id": 1, "event_type": "view", "value": values})
    got, want = _both(spark, tmp_path, "anomaly_peer_linear", events=events)
    assert got == want and len(want) == 1


def test_quantised_search_among_many_alike(spark, tmp_path):
    rng = np.random.default_rng(3)
    q = rng.normal(size=64)
    near = q + rng.normal(size=(600, 64)) * 0.003  # many share their codes, and the codes' order isn't theirs
    far = rng.normal(size=(400, 64))
    held = np.vstack([q, near, far]).astype(np.float32)
    embeddings = pd.DataFrame({"vec_id": range(len(held)), "embedding": list(held), "label": 0})
    got, want = _both(spark, tmp_path, "vector_quantised_topk", embeddings=embeddings)
    assert got == want and len(want) == 10


def _names(rng, n: int) -> list:
    """Names alike and unlike, some short, long, blank or missing."""
    return [[None, "", " ", "ab", "Supp", "Supplier#1", "Łódź & Co", "x" * 90][k] if k < 8 else f"{['Supplier', 'Supply', 'Other'][k % 3]}#{rng.integers(40):04d}" for k in rng.integers(0, 40, n)]


def test_link_pairs_over_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(linkage, "SIZE", 16)
    rng = np.random.default_rng(8)
    supplier = pd.DataFrame({"s_suppkey": range(90), "s_name": _names(rng, 90), "s_nationkey": pd.array(rng.integers(1, 13, 90), "Int32")})
    supplier = supplier[supplier["s_name"].fillna("").str.strip() != ""]
    for name in ("linkage_pairs", "linkage_clusters"):
        got, want = _both(spark, tmp_path, name, supplier=supplier)
        assert got == want and len(want) > 60


def test_jaro_winkler_of_all_with_all():
    rng = np.random.default_rng(2)
    for head, letters in (("", "ab"), ("x", "abcdé "), ("Suppl", "abc")):
        a, b = ([head + "".join(rng.choice(list(letters), rng.integers(0, 14 if k else 80))) for k in range(n)] for n in (40, 30))
        grid, pairs = linkage.jaro_winkler_grid(a, b), linkage.jaro_winkler_pairs([x for x in a for _ in b], [y for _ in a for y in b])
        assert np.array_equal(grid.ravel(), pairs) and np.array_equal(grid, linkage.jaro_winkler_grid(b, a).T)


@pytest.mark.parametrize(("threshold", "compare"), [(0.99, ["zip"]), (0.9, ["zip", "street"]), (0.995, ["zip", "street"]), (0.2, ["zip"]), (0.999, []), (0.9999, ["zip"])])
def test_link_clusters_like_clusters_of_pairs(spark, threshold, compare):
    rng = np.random.default_rng(5)
    some = lambda n: [None if k == 0 else str(k) for k in rng.integers(0, n, 70).tolist()]
    df = spark.createDataFrame(list(zip(map(str, range(70)), _names(rng, 70), some(30), some(40), strict=True)), "id string, firm string, zip string, street string")
    rows = linkage.records(df, "firm", compare, "id", "corpus").cache()
    want = linkage.clusters(rows, linkage.link_pairs(rows, "firm", compare), threshold)
    got = linkage.link_clusters(rows, "firm", compare, threshold=threshold)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_link_clusters_makes_no_pairs_where_names_decide(spark, monkeypatch):
    """5,000 records of one block are 12 million pairs; where only equal names can reach the threshold, none is made."""
    monkeypatch.setattr(linkage, "link_pairs", None)
    rows = spark.range(5000).selectExpr("string(id) AS record_id", "'s' AS source", "concat('Firm ', id % 1700) AS firm", "string(id % 7) AS zip")
    got = linkage.link_clusters(rows, "firm", ["zip"], threshold=0.99)
    assert got.count() == 5000 and got.select("cluster_id").distinct().count() == 1700


def test_hot_blocks_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(linkage, "SIZE", 32)
    rows = spark.range(1000).selectExpr("string(id) AS record_id", "'s' AS source", "concat('Firm ', id) AS firm")
    sizes = [r["n"] for r in linkage.link_pairs(rows, "firm").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 1000 * 999 // 2 and max(sizes) < sum(sizes) / 4

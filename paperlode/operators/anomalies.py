"""Outliers among peers (robust z or interquartile fences) and rare, large groups. One declarative plan each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.functions.columns import fold_change, name_key, number
from paperlode.operators.aggregate import check_field
from paperlode.storage import numbered

THRESHOLDS = {"robust_z": 3.5, "iqr": 1.5}
#: Scale of the median and of the mean absolute deviation to a standard deviation (fixed values).
MAD_SCALE, MEAN_AD_SCALE = 1.4826, 1.2533
_PERSON, _ORG = ("member", "lobbyist", "person"), ("registrant", "client", "org", "name")


def label_kind(field: str, kind: str = "auto") -> str | None:
    """Which names a field is folded as: asked for, or told by the field's own name."""
    if kind != "auto":
        return None if kind in ("none", "") else kind
    low = field.lower()
    return "person" if any(x in low for x in _PERSON) else "org" if any(x in low for x in _ORG) else None


def _rows(df: DataFrame, by: str, measure: str, segment: str | None, canon: DataFrame | None, kind: str) -> DataFrame:
    group = F.col(f"`{check_field(by)}`")
    if dict(df.dtypes)[by].startswith("array"):
        group = F.explode(group)
    rows = df.select("doc_id", group.alias("grp"), number(f"`{check_field(measure)}`").alias("value"), (F.col(f"`{check_field(segment)}`") if segment else F.lit(None)).cast("string").alias("segment"))
    rows = rows.withColumn("grp", F.trim(F.col("grp").cast("string"))).filter("grp <> '' AND value IS NOT NULL")
    folded = label_kind(by, kind)
    if canon is not None and folded:
        named = canon.select(F.col("norm_key").alias("canon_key"), "canonical_name").dropDuplicates(["canon_key"])
        rows = rows.withColumn("canon_key", name_key("grp", folded)).join(named, "canon_key", "left").withColumn("grp", F.coalesce("canonical_name", "grp")).drop("canon_key", "canonical_name")
    return rows


def peer_outliers(df: DataFrame, by: str, measure: str, segment: str | None = None, method: str = "robust_z", threshold: float | None = None, log: bool = True, min_peers: int = 5, min_ratio: float = 1.0, cap: int | None = 3, k: int | None = 50, sort: str = "ratio", canon: DataFrame | None = None, kind: str = "auto", digits: tuple[int, int, int] = (2, 2, 3)) -> DataFrame:
    """Rows whose measure stands out in their group (and segment).

    Gives doc_id, grp, segment, value, group_median, group_n, ratio, score, direction, method, low_confidence.
    digits: to which median, ratio and score are rounded.
    Medians and quartiles are aggregates, counted up where the rows are, and joined back, so no group is
    gathered; cap keeps the first rows of each group among those that stand out.
    """
    if method not in THRESHOLDS:
        raise ValueError(f"method must be one of {tuple(THRESHOLDS)}")
    limit = THRESHOLDS[method] if threshold is None else threshold
    rows = _rows(df, by, measure, segment, canon, kind)
    if log:
        rows = rows.filter("value > 0")
    peers = Window.partitionBy("grp", "segment")
    y: Column = F.ln("value") if log else F.col("value")
    rows = rows.withColumn("y", y)

    def with_peers(rows: DataFrame, *found: Column) -> DataFrame:
        """rows with aggregates over their group and segment."""
        own = rows.groupBy(F.col("grp").alias("peer_grp"), F.col("segment").alias("peer_segment")).agg(*found)
        return rows.join(own, F.col("grp").eqNullSafe(F.col("peer_grp")) & F.col("segment").eqNullSafe(F.col("peer_segment"))).drop("peer_grp", "peer_segment")

    rows = with_peers(rows, F.count(F.lit(1)).alias("group_n"), F.median("value").alias("group_median"), F.percentile("y", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).filter(F.col("group_n") >= min_peers)
    if method == "iqr":
        q1, q3 = F.col("q")[0], F.col("q")[2]
        iqr = q3 - q1
        over, under = F.col("y") - (q3 + F.lit(limit) * iqr), (q1 - F.lit(limit) * iqr) - F.col("y")
        rows = rows.filter(iqr > 0).withColumn("score", F.greatest(over, under) / iqr).filter("score > 0")
        rows = rows.withColumn("direction", F.when(F.col("y") > q3, "high").otherwise("low")).withColumn("how", F.lit("iqr"))
    else:
        rows = rows.withColumn("mid", F.col("q")[1]).withColumn("off", F.abs(F.col("y") - F.col("mid")))
        rows = with_peers(rows, F.median("off").alias("mad"), F.avg("off").alias("mean_ad"))
        scale = F.when(F.col("mad") > 0, F.lit(MAD_SCALE) * F.col("mad")).when(F.col("mean_ad") > 0, F.lit(MEAN_AD_SCALE) * F.col("mean_ad"))
        rows = rows.withColumn("score", (F.col("y") - F.col("mid")) / scale).filter(F.abs("score") >= F.lit(limit))
        rows = rows.withColumn("direction", F.when(F.col("score") > 0, "high").otherwise("low"))
        rows = rows.withColumn("how", F.when(F.col("mad") > 0, "robust_z").otherwise("robust_z/meanad_fallback"))
    ratio = F.when(F.col("group_median") != 0, F.col("value") / F.col("group_median"))
    rows = rows.withColumn("raw_ratio", ratio).filter(F.col("raw_ratio").isNull() | (fold_change("raw_ratio") >= F.lit(min_ratio)))
    first = F.desc_nulls_last(fold_change("raw_ratio")) if sort == "ratio" else F.abs("score").desc()
    order = [first, F.abs("score").desc(), F.col("doc_id").asc()]
    if cap is not None:
        rows = rows.withColumn("place", F.row_number().over(peers.orderBy(*order))).filter(F.col("place") <= cap)
    rows = rows.select("doc_id", "grp", "segment", "value", F.round("group_median", digits[0]).alias("group_median"), "group_n", F.round("raw_ratio", digits[1]).alias("ratio"), F.round("score", digits[2]).alias("score"), "direction", F.col("how").alias("method"), (F.col("group_n") < 10).alias("low_confidence"), "raw_ratio")
    if k is not None:
        rows = rows.orderBy(*order).limit(k)
    return rows.drop("raw_ratio")


def rare_groups(df: DataFrame, by: str, measure: str, max_count: int = 1, pct: float = 95.0, k: int | None = 50, canon: DataFrame | None = None, kind: str = "auto") -> DataFrame:
    """Rows of groups with few records whose sum is among the largest: doc_id, grp, value, group_n, group_sum, rank_pct.

    Groups are numbered in the order of their sums by sorted partitions (storage.numbered); the percentile is
    read off two places and a rank is the first place of equal sums, so no task has all groups.
    """
    rows = _rows(df, by, measure, None, canon, kind)
    groups = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("group_n"), F.sum("value").alias("group_sum"))
    groups = numbered(groups, ["group_sum", "grp"], "group-sums")
    n = groups.count()
    spot = pct / 100 * max(0, n - 1)
    ends = {r["place"]: r["group_sum"] for r in groups.filter(F.col("place").isin(math.floor(spot), math.ceil(spot))).select("place", "group_sum").collect()}  # two rows
    low, high = ends.get(math.floor(spot), 0.0), ends.get(math.ceil(spot), 0.0)
    flagged = groups.filter((F.col("group_n") <= max_count) & (F.col("group_sum") >= F.lit(low + (high - low) * (spot - math.floor(spot)))))
    first = groups.groupBy("group_sum").agg(F.min("place").alias("smaller"))  # groups with a smaller sum
    ranked = flagged.join(first, "group_sum").select("grp", "group_n", "group_sum", F.round(100 * F.col("smaller") / F.lit(max(1, n)), 1).alias("rank_pct"))
    out = rows.join(ranked, "grp").select("doc_id", "grp", "value", "group_n", F.round("group_sum", 2).alias("group_sum"), "rank_pct")
    return out if k is None else out.orderBy(F.desc("group_sum"), "grp", "doc_id").limit(k)

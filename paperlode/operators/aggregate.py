"""Grouped aggregation over fields, with array fields unnested and names folded onto entities."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.functions.columns import name_key, number

FIELD = re.compile(r"^[A-Za-z0-9_.]+$")
KINDS = ("count", "sum", "avg", "min", "max")


def check_field(name: str) -> str:
    if not FIELD.match(name or ""):
        raise ValueError(f"not a field name: {name!r}")
    return name


def aggregate(df: DataFrame, by: str, agg: str = "count", measure: str | None = None, k: int | None = 20, canon: DataFrame | None = None, canon_kind: str = "org") -> DataFrame:
    """group_value, value, n: rows with a group, ordered by value (nulls last, ties by group), first k.

    An array column counts each of its elements as a group of its own. n counts rows, with or without a
    measure. canon (norm_key, canonical_name) folds spellings; keys that it lacks stay as they are, a
    group without any number is 0 and averages are refused, for they can't be folded from groups.
    """
    if agg not in KINDS:
        raise ValueError(f"agg must be one of {KINDS}")
    if agg != "count" and not measure:
        raise ValueError(f"{agg} needs a measure")
    if canon is not None and agg == "avg":
        raise ValueError("averages can't be folded; use sum and count")
    by, measure = check_field(by), measure and check_field(measure)
    group = F.col(f"`{by}`")
    if dict(df.dtypes)[by].startswith("array"):
        group = F.explode(group)
    rows = df.select(group.alias("group_value"), (number(f"`{measure}`") if measure else F.lit(None).cast("double")).alias("x"))
    rows = rows.withColumn("group_value", F.col("group_value").cast("string")).filter("group_value IS NOT NULL")
    if canon is not None:
        named = canon.select(F.col("norm_key").alias("canon_key"), "canonical_name").dropDuplicates(["canon_key"])
        rows = rows.withColumn("canon_key", name_key("group_value", canon_kind)).join(named, "canon_key", "left")
        rows = rows.withColumn("group_value", F.coalesce("canonical_name", "group_value"))
    value = F.count(F.lit(1)).cast("double") if agg == "count" else getattr(F, agg)("x")
    if canon is not None:
        value = F.coalesce(value, F.lit(0.0))
    out = rows.groupBy("group_value").agg(value.alias("value"), F.count(F.lit(1)).alias("n"))
    if k is None:
        return out
    return out.orderBy(F.desc_nulls_last("value"), "group_value").limit(k)

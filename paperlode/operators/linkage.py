"""Probabilistic record linkage (Fellegi-Sunter) over blocked pairs, and clusters of linked records."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.storage import numbered, shared_dir, written

PRIOR = 0.1
#: (label, m, u) of the comparison levels (fixed values): names weigh most, other fields corroborate.
NAME_LEVELS = {"exact": (0.55, 0.0001), "jw90": (0.30, 0.005), "jw80": (0.12, 0.05), "else": (0.03, 0.945)}
WEAK_LEVELS = {"exact": (0.5, 0.2), "jw80": (0.3, 0.3), "else": (0.2, 0.5)}


#: Letters up to which names are compared as matrices, many pairs at a time; longer ones go alone.
WIDE = 64


def _letters(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words (a row each, 0 past the end) and how many there are."""
    raw = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return raw.reshape(len(words), width), np.fromiter(map(len, words), np.int64, len(words))


def jaro_winkler_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro-Winkler similarity of a[i] and b[i], all pairs at once: Jaro similarity, raised (from 0.7) by a
    tenth of what lacks for each of the first four letters in common."""
    if not a:
        return np.zeros(0)
    width = max(1, *map(len, a), *map(len, b))
    (x, nx), (y, ny) = _letters(a, width), _letters(b, width)
    reach = np.maximum(0, np.maximum(nx, ny) // 2 - 1)
    mine, theirs = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
    widest = int(reach.max())
    for i in range(width):  # each letter of a takes the first free one of b within reach
        free = i < nx
        for j in range(max(0, i - widest), min(width, i + widest + 1)):
            took = free & (j < ny) & (abs(i - j) <= reach) & ~theirs[:, j] & (x[:, i] == y[:, j])
            theirs[:, j] |= took
            free &= ~took
            mine[:, i] |= took
    m = mine.sum(axis=1)
    in_order = lambda letters, kept: np.take_along_axis(letters, np.argsort(~kept, axis=1, kind="stable"), axis=1)
    differ = (in_order(x, mine) != in_order(y, theirs)) & (np.arange(width) < m[:, None])
    swaps = differ.sum(axis=1) // 2  # pairs of letters out of order; an odd one doesn't count
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(m > 0, (m / nx + m / ny + (m - swaps) / m) / 3, 0.0)
    same = np.cumprod((x[:, :4] == y[:, :4]) & (np.arange(min(4, width)) < np.minimum(nx, ny)[:, None]), axis=1).sum(axis=1)
    out = np.where(out > 0.7, out + same * 0.1 * (1 - out), out)
    return np.where((nx == 0) & (ny == 0), 1.0, out)


def jaro_winkler(a: str, b: str) -> float:
    return float(jaro_winkler_pairs([a], [b])[0])


def jaro_winkler_column(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = pd.DataFrame({"x": x.to_numpy(), "y": y.to_numpy()})
        known = (pairs["x"].notna() & pairs["y"].notna()).to_numpy()
        number = pairs[known].groupby(["x", "y"], sort=False).ngroup().to_numpy(np.int64)
        first = pairs[known].drop_duplicates()  # each pair of values once, in the same order
        wide = (first["x"].str.len() > WIDE) | (first["y"].str.len() > WIDE)
        scores = np.zeros(len(first))
        short = first[~wide]
        scores[(~wide).to_numpy()] = jaro_winkler_pairs(short["x"].tolist(), short["y"].tolist())
        scores[wide.to_numpy()] = [jaro_winkler(p, q) for p, q in first[wide].itertuples(index=False)]
        out = np.full(len(pairs), np.nan)
        out[known] = scores[number]
        return pd.Series(out).where(known, None).astype("float64")

    return run(a, b)


def jaro_winkler_grid(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro-Winkler similarity of every a with every b. Letters that all of them begin with are in place in
    every pair, so only what follows is compared."""
    for words in (a, b):  # long words go apart, else all were compared at their width
        wide = np.fromiter((len(w) > WIDE for w in words), bool, len(words))
        if wide.any() and not wide.all():
            out = np.zeros((len(a), len(b)))
            for part in (wide, ~wide):
                own = [words[i] for i in np.flatnonzero(part)]
                if words is a:
                    out[part] = jaro_winkler_grid(own, b)
                else:
                    out[:, part] = jaro_winkler_grid(a, own)
            return out
    if not a or not b:
        return np.zeros((len(a), len(b)))
    head = len(os.path.commonprefix([*a, *b]))
    width = max(1, *(len(w) - head for w in (*a, *b)))
    if width * len(a) * len(b) > 1 << 25 and len(a) > 1:
        return np.vstack([jaro_winkler_grid(a[: len(a) // 2], b), jaro_winkler_grid(a[len(a) // 2 :], b)])
    (x, nx), (y, ny) = _letters([w[head:] for w in a], width), _letters([w[head:] for w in b], width)
    known, code = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True)
    code = (code + 1).astype(np.min_scalar_type(len(known) + 1))  # 0 stands for no letter
    x, y = (np.ascontiguousarray(c.reshape(-1, width).T) for c in (code[: x.size], code[x.size :]))
    nx, ny = nx[:, None], ny[None, :]
    reach = np.maximum(0, (np.maximum(nx, ny) + head) // 2 - 1)
    mine, theirs = np.zeros((2, width, len(a), len(b)), bool)
    least, widest = int(reach.min()), int(reach.max())
    for i in range(width):  # each letter of a takes the first free one of b within reach
        free = np.repeat(i < nx, len(b), axis=1)
        for j in range(max(0, i - widest), min(width, i + widest + 1)):
            took = x[i][:, None] == y[j][None, :]
            took &= free
            np.greater(took, theirs[j], out=took)
            if j >= ny.min():
                took &= j < ny
            if abs(i - j) > least:
                took &= abs(i - j) <= reach
            theirs[j] |= took
            mine[i] |= took
            free ^= took

    def in_order(letters: np.ndarray, kept: np.ndarray) -> np.ndarray:
        out, place = np.zeros(kept.shape, code.dtype), np.zeros(kept.shape[1:], np.int32)
        for i in range(width):
            for r in range(i + 1):
                np.copyto(out[r], letters[i], where=kept[i] & (place == r))
            place += kept[i]
        return out

    m = mine.sum(axis=0, dtype=np.int64) + head
    swaps = (in_order(x[:, :, None], mine) != in_order(y[:, None, :], theirs)).sum(axis=0) // 2
    nx, ny = nx + head, ny + head
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(m > 0, (m / nx + m / ny + (m - swaps) / m) / 3, 0.0)
    same, still = np.full(out.shape, min(head, 4)), np.ones(out.shape, bool)
    for i in range(min(4 - min(head, 4), width)):
        still &= (x[i][:, None] == y[i][None, :]) & (i + head < np.minimum(nx, ny))
        same += still
    out = np.where(out > 0.7, out + same * 0.1 * (1 - out), out)
    return np.where((nx == 0) & (ny == 0), 1.0, out)


def _weights(levels: dict[str, tuple[float, float]]) -> np.ndarray:
    """Logarithms of the ratios of the levels of _levels_of; 0 where a value is missing."""
    ratio = {k: math.log(m / u) for k, (m, u) in levels.items()}
    return np.array([ratio["else"], ratio["jw80"], ratio.get("jw90", ratio["jw80"]), ratio["exact"], 0.0])


def _levels_of(a: list, b: list) -> np.ndarray:
    """The level of every value of a with every one of b: else, jw80, jw90, exact, missing."""
    u, v = ({w: i for i, w in enumerate(dict.fromkeys(words))} for words in (a, b))
    jw = jaro_winkler_grid([w or "" for w in u], [w or "" for w in v])
    level = (jw >= 0.8).astype(np.int8) + (jw >= 0.9)
    for w in u.keys() & v.keys():
        level[u[w], v[w]] = 3
    if None in u:
        level[u[None]] = 4
    if None in v:
        level[:, v[None]] = 4
    return level[np.ix_([u[w] for w in a], [v[w] for w in b])]


def _probability(total):
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-np.asarray(total, np.float64)))


def records(df: DataFrame, on: str, compare: list[str], id_col: str, source: str) -> DataFrame:
    """record_id, source, on and compare as text; rows without a name go, blank fields are null."""
    text = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    return df.select(F.col(id_col).cast("string").alias("record_id"), F.lit(source).alias("source"), text(on).alias(on), *(text(c).alias(c) for c in compare if c != on)).filter(F.col(on).isNotNull())


#: Rows of a block that are compared with as many others at a time.
SIZE = 512


def _scorer(n_fields: int, weights: list[np.ndarray], least: float | None, digits: int | None):
    """Arrow batches of pairs of chunks to src, dst, match_probability of their rows."""

    def probabilities(a: list[tuple], b: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """A number for each pair of rows with different values, and the probability that belongs to a number."""
        code, totals = np.zeros((len(a), len(b)), np.int64), np.array([math.log(PRIOR / (1 - PRIOR))])
        for f, w in enumerate(weights):
            code = code * len(w) + _levels_of([t[f] for t in a], [t[f] for t in b])
            totals = (totals[:, None] + w[None, :]).ravel()
            if len(totals) > 10_000:
                used, code = np.unique(code, return_inverse=True)
                code, totals = code.reshape(len(a), len(b)), totals[used]
        return code, _probability(totals)

    def pairs(block: int, same: bool, a_ids: pa.Array, a: list[tuple], b_ids: pa.Array, b: list[tuple]) -> pa.RecordBatch:
        u, v = ({t: i for i, t in enumerate(dict.fromkeys(rows))} for rows in (a, b))
        at, bt, u, v = np.array([u[t] for t in a]), np.array([v[t] for t in b]), list(u), list(v)
        code, odds = probabilities(u, v)
        keep = np.ones(code.shape, bool) if least is None else (odds >= least)[code]
        for j in range(block):  # made by an earlier block
            mine, theirs = ([t[j][:4] if j == 0 else t[j] for t in w] for w in (u, v))
            number = {w: i for i, w in enumerate({*mine, *theirs} - {None})}
            keep &= np.array([number.get(w, -1) for w in mine])[:, None] != np.array([number.get(w, -2) for w in theirs])[None, :]
        if digits is not None:
            odds = np.array([float(Decimal(repr(float(p))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for p in odds])
        ids = pa.concat_arrays([a_ids, b_ids])
        names = ids.to_pylist()
        order = {w: i for i, w in enumerate(sorted(set(names)))}
        rank = np.array([order[w] for w in names], np.int32)
        mine, theirs = rank[: len(a)], rank[len(a) :]
        kept = keep[at[:, None], bt[None, :]] & (mine[:, None] != theirs[None, :])
        if same:
            kept = np.triu(kept, 1)
        i, j = np.nonzero(kept)
        turned = mine[i] > theirs[j]
        other = j + len(a)
        src, dst = np.where(turned, other, i), np.where(turned, i, other)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(src)), ids.take(pa.array(dst)), pa.array(odds[code[at[i], bt[j]]])], ["src", "dst", "match_probability"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                of = lambda c: batch.column(c)[k].values  # noqa: B023, E731
                rows = [list(zip(*(of(f"{side}_f{f}").to_pylist() for f in range(n_fields)), strict=True)) for side in "ab"]
                yield pairs(batch.column("block")[k].as_py(), batch.column("same")[k].as_py(), of("a_id"), rows[0], of("b_id"), rows[1])

    return run


def link_pairs(rows: DataFrame, on: str, compare: list[str] | None = None, levels: dict | None = None, least: float | None = None, digits: int | None = None, same_name: bool = False) -> DataFrame:
    """src, dst (src < dst), match_probability of every pair that shares a block: the first four letters
    of the name, or one compared field. least: pairs below that probability are left out; digits: to which it
    is rounded; same_name: only pairs with equal names.

    A block's rows are numbered in the order of their values and cut into chunks of SIZE; two chunks at a time
    are a row of a task, so a block of any size is dealt evenly, and different values in them are scored once.
    A pair of several blocks is made by the first of them only."""
    compare = [c for c in compare or [] if c != on]
    spark, fields = rows.sparkSession, [f"f{i}" for i in range(len(compare) + 1)]
    rows = rows.select(F.col("record_id").cast("string").alias("record_id"), *(F.col(f"`{c}`").cast("string").alias(f) for c, f in zip([on, *compare], fields, strict=True)))
    keys = [F.col("f0")] if same_name else [F.substring("f0", 1, 4), *(F.col(f) for f in fields[1:])]
    blocks = rows.select("*", F.posexplode(F.array(*keys)).alias("block", "key")).filter("key IS NOT NULL")
    held = numbered(blocks, ["block", "key", *fields, "record_id"], "linkage-rows")
    head = F.substring("f0", 1, 4)
    chunks = held.groupBy("block", "key", F.floor(F.col("place") / SIZE).alias("chunk")).agg(F.collect_list(F.struct("record_id", *fields)).alias("r"), F.min(head).alias("low"), F.max(head).alias("high"))
    chunks = written(chunks.select("block", "key", "chunk", F.col("r.record_id").alias("id"), *(F.col(f"r.{f}").alias(f) for f in fields), F.when(F.col("low") == F.col("high"), F.col("low")).alias("head")), "linkage-chunks")
    ends = chunks.groupBy("block", "key").agg(F.max("chunk").alias("last"), F.count(F.lit(1)).alias("n"))
    n = ends.agg(F.sum(F.col("n") * (F.col("n") + 1) / 2)).first()[0] or 1  # pairs of chunks
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("id", *fields, "head")]
    left = chunks.join(ends, ["block", "key"]).select("block", "key", "chunk", F.explode(F.sequence("chunk", "last")).alias("to"), *side("a"))
    right = chunks.select("block", "key", F.col("chunk").alias("to"), *side("b"))
    both = left.join(right, ["block", "key", "to"]).filter((F.col("block") == 0) | F.coalesce(F.col("a_head") != F.col("b_head"), F.lit(True)))  # else the first block makes all pairs
    tasks = max(min(int(n), spark.sparkContext.defaultParallelism), -(-int(n) // 16))
    both = both.repartition(tasks, "block", "key", "chunk", "to").withColumn("same", F.col("chunk") == F.col("to")).drop("key", "chunk", "to", "a_head", "b_head")
    weights = [_weights(levels or NAME_LEVELS), *(_weights(WEAK_LEVELS) for _ in compare)]
    return both.mapInArrow(_scorer(len(fields), weights, least, digits), "src string, dst string, match_probability double")


def trained_levels(rows: DataFrame, on: str, levels: dict | None = None, most: int = 100_000, seed: int = 0) -> dict:
    """levels with u estimated on random pairs: rows matched with rows at a random other place."""
    levels = dict(levels or NAME_LEVELS)
    bins = F.floor(F.rand(seed) * F.lit(1 << 20))
    a = rows.orderBy(F.xxhash64("record_id", F.lit(1))).limit(most).select(F.col(on).alias("a")).withColumn("bin", bins % 1024)
    b = rows.orderBy(F.xxhash64("record_id", F.lit(2))).limit(most).select(F.col(on).alias("b")).withColumn("bin", bins % 1024)
    jw = a.join(b, "bin").limit(most).withColumn("jw", jaro_winkler_column(F.col("a"), F.col("b")))
    got = jw.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("exact"), F.count_if((F.col("a") != F.col("b")) & (F.col("jw") >= 0.9)).alias("jw90"), F.count_if((F.col("jw") < 0.9) & (F.col("jw") >= 0.8)).alias("jw80")).first()
    if not got["n"]:
        return levels
    share = {k: max(got[k] / got["n"], 1e-4) for k in ("exact", "jw90", "jw80")}
    share["else"] = max(1 - sum(share.values()), 1e-4)
    return {k: (m, share[k]) for k, (m, _) in levels.items()}


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, cluster_id (smallest id that edges(src, dst) lead to) for every node. Each round hangs the larger
    neighbours of a node on the smallest one around, then the smaller ones too (large star, small star),
    until every node hangs on one that hangs on none; lineage is cut by checkpoints."""
    shared_dir(nodes.sparkSession)  # where checkpoints go
    links = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct().checkpoint()
    while True:
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        links = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct().checkpoint()
        low = links.groupBy("u").agg(F.min("v").alias("low"))
        rest = links.join(low, "u").filter("v <> low").select("v", "low")
        links = low.union(rest).distinct().toDF("u", "v").checkpoint()
        several = links.groupBy("u").count().filter("count > 1")
        if several.isEmpty() and links.join(links.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    return nodes.join(links.withColumnsRenamed({"u": "id", "v": "cluster_id"}), "id", "left").select("id", F.coalesce("cluster_id", "id").alias("cluster_id"))


def clusters(rows: DataFrame, pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """record_id, source, cluster_id of all records; those without a link are alone."""
    near = connected(rows.select(F.col("record_id").alias("id")), pairs.filter(F.col("match_probability") >= threshold).select("src", "dst"))
    return rows.join(near.withColumnRenamed("id", "record_id"), "record_id")


def link_clusters(rows: DataFrame, on: str, compare: list[str] | None = None, levels: dict | None = None, threshold: float = 0.9) -> DataFrame:
    """clusters() of the pairs of link_pairs(), without all of them: rows with equal values are one class,
    hung on its smallest record, and classes are compared. Where equal names are enough for the threshold,
    a name is a class; where nothing less than an equal name reaches it, no other names are compared."""
    compare = [c for c in compare or [] if c != on]
    name, weak, prior = _weights(levels or NAME_LEVELS), _weights(WEAK_LEVELS), math.log(PRIOR / (1 - PRIOR))
    sure = _probability(prior + name[3] + len(compare) * weak.min() - 1e-9) >= threshold
    others = _probability(prior + name[:3].max() + len(compare) * weak.max() + 1e-9) >= threshold
    values = [F.col(f"`{c}`").cast("string") for c in (on, *compare)]
    keyed = rows.select("record_id", F.to_json(F.struct(*(v.alias(f"f{i}") for i, v in enumerate(values)))).alias("class"), *(v.alias(f"f{i}") for i, v in enumerate(values)))
    links = []
    if sure:
        first = keyed.groupBy("f0").agg(F.min("record_id").alias("dst"))
        links.append(keyed.join(first, "f0").select(F.col("record_id").alias("src"), "dst"))
    if others or not sure:
        fields = [f"f{i}" for i in range(len(values))]
        classes = keyed.groupBy("class", *fields).agg(F.min("record_id").alias("first"))
        found = written(link_pairs(classes.withColumnRenamed("class", "record_id"), "f0", fields[1:], levels, threshold, same_name=not others).select("src", "dst"), "linkage-classes")
        end = lambda c: classes.select(F.col("class").alias(c), F.col("first").alias(f"{c}_first"))
        links.append(found.join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_first").alias("src"), F.col("dst_first").alias("dst")))
        own = F.lit(prior + float(name[3]))
        for f in fields[1:]:
            own = own + F.when(F.col(f).isNull(), 0.0).otherwise(float(weak[3]))
        linked = found.select(F.col("src").alias("class")).union(found.select("dst")).union(classes.filter(1 / (1 + F.exp(-own)) >= threshold).select("class")).distinct()
        links.append(keyed.join(classes.select("class", "first").join(linked, "class", "left_semi"), "class").select(F.col("record_id").alias("src"), F.col("first").alias("dst")))
    edges = links[0]
    for more in links[1:]:
        edges = edges.union(more)
    return clusters(rows, edges.withColumn("match_probability", F.lit(threshold)), threshold)


def merged(clustered: DataFrame, on: str) -> DataFrame:
    """cluster_id, size, names, sources, record_ids of clusters of several records, largest first."""
    out = clustered.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_set(on)).alias("names"), F.sort_array(F.collect_set("source")).alias("sources"), F.sort_array(F.collect_list("record_id")).alias("record_ids"))
    return out.filter("size > 1").orderBy(F.desc("size"), "cluster_id")

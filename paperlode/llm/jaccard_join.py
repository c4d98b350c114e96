"""Exact Jaccard self-join of shingle sets, with set-relation skipping.

1. Texts are packed into blocks. Blocks send the smallest hashes of each set (a prefix that a linked
   set must share in part) to hash buckets, which answer with those that several texts have. A set
   whose prefix has too few of them has no link and leaves: most do.
2. Of equal sets one stands for all (class). Classes are numbered, and joined by their numbers.
3. Answer-level skipping. Sets that share a min-hash propose the most popular of them as centre, and
   its overlap with each is computed once. Two sets of one centre differ from it by few shingles,
   and their overlap follows from those differences alone: |x&y| = |c| - |c-x| - |c-y| + common
   differences. So they are joined over differences. For components two that are both linked to the
   centre aren't joined at all; where links are counted, pairs that are linked whatever their
   differences share are counted from the sorted weights, and only the other ones are joined.
4. Index-level skipping. Lists (a difference under a centre, or a shingle of a prefix, rarest first)
   hold their sets by position; blocks of a list are skipped as a whole where the best of their
   positions and sizes can't reach the overlap asked for, or where all have one centre. Lists longer
   than a chunk are dealt to several tasks, as pairs of chunks.
5. Candidates are verified on whole sets. Components come from the links by min-label propagation.

Min-hashes that very many sets share are joined by broadcast, so no task gets a hot one's rows (see
common.join_by_key). Shingles are compared as 64-bit hashes and equal sets by 128 bits of them, never as
words. No list, set or component is ever collected, and pairs of one centre's near copies are not listed
unless they need their differences to be linked.

Defined cases: null or empty text, and text of white space, has no shingles and no link; fewer words
than a shingle make one; rows that repeat an id are one document with the link of each text; a null id
has no id to be linked by and forms no component (component null, no links); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperlode.llm.blocks import NO_ID, blocked, total_bytes, unpacked
from paperlode.llm.common import bucketed, buckets_for, discard, join_by_key, mix64, scratch, table, table_name, written, written_at
from paperlode.llm.shingles import sets_of

#: Min-hashes by which a set looks for centres; share of common shingles a centre needs.
ROUNDS, CENTRE = 4, 0.5
#: Entries of a list that one task takes, at most and (of small inputs) at least; entries of a block inside.
CHUNK, LEAST_CHUNK, BLOCK = 4096, 256, 256
#: Bytes of tokens in a pack of sets.
PACK_BYTES = 1 << 22
#: Hash buckets are at least this many times the shuffle partitions.
BUCKETS = 4


class Threshold:
    """Similarity of at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the similarity must be over 0 and 1 at most")
        self.num, self.den, self.both = num, den, num + den

    def least_of_self(self, n):
        """Overlap that a link of a set of n needs at least."""
        return -(-self.num * n // self.den)

    def extra(self, n):
        """By how much prefixes are longer than they must be, and so how much of them must be shared."""
        return np.maximum(1, (self.den - self.num) * n // (2 * self.den))


def _prefix(s: np.ndarray, t: Threshold) -> np.ndarray:
    n = len(s)
    return s[: n - int(t.least_of_self(n)) + int(t.extra(n))]


def _text_sets(row: dict, words: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    ids, known, ends, text = unpacked(row)
    return ids, known, sets_of(text, np.concatenate([[0], ends]), words)


def _send_prefixes(buckets: int, words: int, t: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, sets = _text_sets(row, words)
                own = [_prefix(s, t) for s in {s.tobytes(): s for s in sets if len(s)}.values()]
                if not own:
                    continue
                h, n = np.unique(np.concatenate(own), return_counts=True)
                cut = np.searchsorted(h, np.array([(b << 64) // buckets for b in range(buckets)], np.uint64))
                spans = [(b, s, e) for b, (s, e) in enumerate(zip(cut.tolist(), [*cut[1:].tolist(), len(h)], strict=True)) if s < e]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in spans], pa.int32()), pa.array([row["block"]] * len(spans), pa.int64()), pa.array([h[s:e].tobytes() for _, s, e in spans], pa.binary()), pa.array([np.packbits(n[s:e] > 1).tobytes() for _, s, e in spans], pa.binary())], ["bucket", "block", "hashes", "several"])

    return run


def _shared(rows: pa.Table) -> pa.Table:
    """For each block the hashes that other texts have as well."""
    parts = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[: len(p)] for x, p in zip(rows.column("several").to_pylist(), parts, strict=True)])
    h = np.concatenate(parts)
    order = np.argsort(h, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    sizes = np.diff(np.append(heads, len(h)))
    flag = np.empty(len(h), bool)
    flag[order] = np.repeat((sizes > 1) | (np.maximum.reduceat(several[order], heads) > 0), sizes)
    out, start = [], 0
    for block, part in zip(rows.column("block").to_pylist(), parts, strict=True):
        own = part[flag[start : start + len(part)]]
        start += len(part)
        if len(own):
            out.append((block, own.tobytes()))
    return pa.table({"block": pa.array([b for b, _ in out], pa.int64()), "shared": pa.array([x for _, x in out], pa.binary())})


SETS = "id bigint, n bigint, sig_a bigint, sig_b bigint, tokens binary"


def _signature(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(np.sum(mix64(s ^ np.uint64(c)), dtype=np.uint64).view(np.int64)) for c in (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B))


def _sets(words: int, t: Threshold):
    """Size and signature of every set; the tokens of those that may have a link, once a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for row in batch.to_pylist():
                ids, known, sets = _text_sets(row, words)
                wanted = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in row["shared"]])) if row["shared"] else np.zeros(0, np.uint64)
                out, sent = [], set()
                for j in np.argsort(ids, kind="stable").tolist():
                    s = sets[j]
                    tokens, sig = None, _signature(s)
                    if len(s) and len(wanted) and known[j] and sig not in sent:
                        p = _prefix(s, t)
                        hits = np.count_nonzero(wanted[np.minimum(np.searchsorted(wanted, p), len(wanted) - 1)] == p)
                        if hits >= t.extra(int(t.least_of_self(len(s)))):
                            tokens = s.tobytes()
                            sent.add(sig)
                    out.append((int(ids[j]) if known[j] else None, len(s), *sig, tokens))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "n", "sig_a", "sig_b", "tokens"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = batch.column(0), []
        for raw in batch.column(1).to_pylist():
            s = np.frombuffer(raw, np.uint64)
            keys.append([int(mix64(s ^ np.uint64(r * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).min().view(np.int64)) for r in range(1, ROUNDS + 1)])
        yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.list_(pa.int64()))], ["id", "keys"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Differences of a set and a proposed centre, where they have CENTRE in common."""
    for batch in batches:
        out = []
        for ident, centre, score, mine, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, c = np.frombuffer(mine, np.uint64), np.frombuffer(other, np.uint64)
            both = len(np.intersect1d(x, c, assume_unique=True))
            if both >= CENTRE * (len(x) + len(c) - both):
                out.append((ident, centre, score, len(c), len(c) - both, len(x) - both, np.setxor1d(x, c, assume_unique=True).tobytes()))
        kinds = [pa.int64()] * 6 + [pa.binary()]
        names = ["id", "centre", "score", "n_centre", "gone", "added", "differences"]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], names)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["x", "y", "both"])


def _join_lists(t: Threshold, by_centre: bool, whole: bool = False):
    """Pairs of a list that may be linked. Rows of a list stand together: list, id, a, b, c.

    Over differences (by_centre): a = differences from this position on, b = weight of the differences,
    c = what a link allows the two weights more than that; pairs that are both linked to the centre are left
    out, or if whole only those whose weights alone make a link. Over shingles: a = position, b = size, c = centre.
    A list that several chunks share has them in side (0: both sides)."""

    def fits(x, y):
        (_, xs, xa, xb, xc), (_, ys, ya, yb, yc) = (tuple(v[..., k] for k in range(5)) for v in (x, y))
        apart = (xs == 0) | (xs != ys)
        if by_centre:
            open_ = xb + yb > xc if whole else (xb > xc) | (yb > yc)
            return apart & (t.both * np.minimum(xa, ya) >= xb + yb - xc) & open_
        need = -(-t.num * (xb + yb) // t.both)
        return apart & (xc != yc) & (1 + np.minimum(xb - xa, yb - ya) - 1 >= need) & (t.den * np.minimum(xb, yb) >= t.num * np.maximum(xb, yb))

    def may_fit(x, y) -> bool:
        """Whether the best of two blocks could be linked."""
        if by_centre:
            best = t.both * min(x[:, 2].max(), y[:, 2].max()) >= x[:, 3].min() + y[:, 3].min() - x[0, 4]
            return bool(best and (x[:, 3].max() + y[:, 3].max() > x[0, 4] if whole else x[:, 3].max() > x[0, 4] or y[:, 3].max() > x[0, 4]))
        if x[0, 4] == y[0, 4] and (x[:, 4] == x[0, 4]).all() and (y[:, 4] == y[0, 4]).all():
            return False
        return bool(t.den * x[:, 3].max() >= t.num * y[:, 3].min() and t.den * y[:, 3].max() >= t.num * x[:, 3].min())

    def pairs(rows: np.ndarray) -> Iterator[np.ndarray]:
        order = np.lexsort((-rows[:, 2], rows[:, 3])) if by_centre else np.lexsort((rows[:, 3], rows[:, 4]))
        rows = rows[order]
        blocks = [rows[s : s + BLOCK] for s in range(0, len(rows), BLOCK)]
        for i, x in enumerate(blocks):
            for y in blocks[i:]:
                if not may_fit(x, y):
                    continue
                ok = fits(x[:, None, :], y[None, :, :])
                if x is y:
                    ok = np.triu(ok, 1)
                a, b = np.nonzero(ok)
                if len(a):
                    found = np.stack([x[a, 0], y[b, 0]], axis=1)
                    found.sort(axis=1)
                    yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def emit() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            for found in pairs(rows):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["x", "y"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(j).to_numpy(zero_copy_only=False) for j in range(batch.num_columns)]
            key = np.stack(cols[:4], axis=1)
            rows = np.stack([cols[4], cols[5], cols[6], cols[7], cols[8]], axis=1)
            heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            ends = [*heads[1:].tolist(), len(key)]
            for s, e in zip(heads.tolist(), ends, strict=True):
                own = tuple(key[s])
                if own != last:
                    if held and sum(map(len, held)) > 1:
                        yield from emit()
                    held, last = [], own
                held.append(rows[s:e])
        if held and sum(map(len, held)) > 1:
            yield from emit()

    return run


def _candidates(entries: DataFrame, t: Threshold, by_centre: bool, whole: bool = False) -> DataFrame:
    """entries: centre, token, id, a, b, c. Lists of one entry are dropped, long ones dealt in pairs of chunks."""
    key = ["centre", "token"] if by_centre else ["token"]
    if not by_centre:
        entries = entries.withColumn("centre", F.lit(0).cast("bigint"))
        key = ["token", "centre"]
    size = [F.count(F.lit(1)).alias("n_list"), *([] if by_centre else [F.min("c").alias("low"), F.max("c").alias("high")])]
    lists = entries.groupBy(*key).agg(*size).filter("n_list > 1" if by_centre else "n_list > 1 AND low <> high").drop("low", "high")
    lists = written(lists, "lists")
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = lists.agg(F.sum("n_list")).first()[0] or 0
    chunk = min(CHUNK, max(LEAST_CHUNK, total // (8 * parts)))  # a small share of what a task gets anyway
    chunks = F.ceil(F.col("n_list") / F.lit(chunk)).cast("int")
    rows = entries.join(lists, key).withColumn("chunks", chunks)
    own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    low, high = F.least("own", "other").cast("bigint"), F.greatest("own", "other").cast("bigint")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("bigint")
    rows = rows.select("centre", "token", low.alias("low"), high.alias("high"), "id", side.alias("side"), *(F.col(x).cast("bigint") for x in "abc"))
    rows = rows.repartition(parts, "centre", "token", "low", "high").sortWithinPartitions("centre", "token", "low", "high")
    return rows.mapInArrow(_join_lists(t, by_centre, whole), "x bigint, y bigint").distinct()


def _join_sets(pairs: DataFrame, left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """pairs(x, y) with the column of both: x's of left, y's of right. A hot x or y is split by AQE."""
    a = left.select(F.col("id").alias("x"), F.col(column).alias("x_set"))
    b = right.select(F.col("id").alias("y"), F.col(column).alias("y_set"))
    return pairs.join(a, "x").join(b, "y")


def components(links: DataFrame) -> DataFrame:
    """id and the smallest id that links(x, y) lead to; each round takes the smallest label of the
    neighbours and then the label of the label, and is written in place of the one before."""
    spark = links.sparkSession
    edges = written(links.select(F.col("x").alias("u"), F.col("y").alias("v")).union(links.select("y", "x")).distinct(), "edges")
    labels, path = written_at(edges.groupBy(F.col("u").alias("id")).agg(F.least(F.col("id"), F.min("v")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("jump"))
        step = step.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("jump", "label")).alias("label"))
        step, step_path = written_at(step, "labels")
        discard(spark, path)
        changed, path = not step.filter("old <> label").isEmpty(), step_path
        labels = step.select("id", "label")
        if not changed:
            return labels


def _certain(centred: DataFrame) -> DataFrame:
    """id, n_links: with how many others of its centre a set is linked by the two weights alone. Weights
    are counted first, so a centre's rows are its different weights, not its sets."""
    linked = centred.filter("weight <= slack").select("id", "centre", "weight", "slack")
    sizes = linked.groupBy("centre", "weight", "slack").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("bigint")
    held = sizes.select("centre", F.col("weight").alias("at"), F.lit(0).alias("asks"), "n", "weight", "slack")
    asks = sizes.select("centre", (F.col("slack") - F.col("weight")).alias("at"), F.lit(1).alias("asks"), none.alias("n"), "weight", "slack")
    upto = F.sum("n").over(Window.partitionBy("centre").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.when(2 * F.col("weight") <= F.col("slack"), 1).otherwise(0)
    found = held.unionByName(asks).withColumn("upto", upto).filter("asks = 1").select("centre", "weight", (F.col("upto") - own).alias("n_links"))
    return linked.join(found, ["centre", "weight"]).select("id", "n_links").filter("n_links > 0")


def similar_sets(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(documents, classes, links, certain): every row's id, n and class signature; the class's number and
    smallest id; links (x, y) between classes by their numbers; None. Of links between sets that are both
    linked to their common centre only those with the centre are listed; they join the same components.
    If whole, all links are there: certain (id, n_links) counts those that are not listed."""
    t, spark = Threshold(num, den), docs.sparkSession
    blocks, blocks_path = blocked(docs, id_col, text_col)
    buckets, parts = buckets_for(spark, total_bytes(blocks), BUCKETS)
    sent = blocks.mapInArrow(_send_prefixes(buckets, words, t), "bucket int, block bigint, hashes binary, several binary").repartition(parts, "bucket")
    shared = sent.groupBy("bucket").applyInArrow(_shared, "block bigint, shared binary")
    shared = shared.groupBy("block").agg(F.collect_list("shared").alias("shared"))  # of one block, so bounded by it
    every = written(blocks.join(shared.hint("shuffle_hash"), "block", "left").mapInArrow(_sets(words, t), SETS), "sets")
    discard(spark, blocks_path)

    sig = ["sig_a", "sig_b", "n"]
    classes = every.filter("n > 0 AND id IS NOT NULL").groupBy(*sig).agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_rows"))
    # numbered in the order of the ids, which decides between centres
    classes = written(classes.orderBy("class_id", *sig).withColumn("class", F.monotonically_increasing_id()), "classes")
    kept = every.filter("tokens IS NOT NULL").join(classes, sig).filter("id = class_id").select(F.col("class").alias("id"), "n", "tokens").dropDuplicates(["id"])
    sets_by_id, sets = bucketed(kept, "id", "class-sets")

    keys = sets.select("id", "tokens").mapInArrow(_keys, "id bigint, keys array<bigint>").select("id", F.posexplode("keys").alias("round", "key"))
    keys = written(keys, "keys")
    n_keys = keys.count()
    popular = written(keys.groupBy("round", "key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "popular")
    keys = written(join_by_key(keys, popular, ["round", "key"], "held", n_keys), "held-keys")
    scores = keys.groupBy("id").agg(F.sum("held").alias("score"))
    keys = written(keys.join(scores, "id"), "scored-keys")
    best = keys.groupBy("round", "key").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("best"), F.first("held").alias("n_held"))
    proposed = join_by_key(keys, written(best, "best"), ["round", "key"], "n_held", n_keys)
    proposed = proposed.select("id", (-F.col("best.minus")).alias("centre"), F.col("best.score").alias("score")).filter("id <> centre").distinct()
    proposed = written(proposed.withColumnsRenamed({"id": "x", "centre": "y"}), "proposed")
    asked = _join_sets(proposed, sets_by_id, sets, "tokens").select("x", "y", "score", "x_set", "y_set")
    found = asked.mapInArrow(_differences, "id bigint, centre bigint, score bigint, n_centre bigint, gone bigint, added bigint, differences binary")
    found = written(found, "differences")
    found = found.withColumn("r", F.struct("score", (-F.col("centre")).alias("minus"), "n_centre", "gone", "added", "differences"))
    chosen = found.groupBy("id").agg(F.max("r").alias("r"))
    chosen = written(chosen.select("id", (-F.col("r.minus")).alias("centre"), "r.n_centre", "r.gone", "r.added", "r.differences"), "centres")

    slack = (F.lit(den - num) * F.col("n_centre")).alias("slack")
    weight = (F.lit(den) * F.col("gone") + F.lit(num) * F.col("added")).alias("weight")
    centred = chosen.select("id", "centre", "differences", slack, weight, (F.col("gone") + F.col("added")).alias("n_diff"))
    direct = centred.filter("weight <= slack").select(F.col("id").alias("x"), F.col("centre").alias("y"))
    certain = written(_certain(centred), "certain") if whole else None

    # over the differences: prefixes that a pair must share of which one isn't linked to the centre, or
    # if whole any pair that the two weights alone don't link
    need = F.when(F.col("weight") <= F.col("slack"), F.lit(1).cast("bigint") if whole else F.expr(f"(weight + 1 + {t.both - 1}) div {t.both}")).otherwise(F.expr(f"(weight - slack + {t.both - 1}) div {t.both}"))
    centred = centred.withColumn("take", F.col("n_diff") - need + 1).filter("take > 0")
    tokens = centred.withColumn("token", F.explode(_longs("differences"))).drop("differences")
    held = tokens.groupBy("centre", "token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    tokens = tokens.join(held, ["centre", "token"])
    per_set = tokens.groupBy("id", "centre", "weight", "slack", "n_diff", "take").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))  # bounded by a set
    lone = F.col("n_diff") - F.size("own")  # differences that no other set has come first
    entries = per_set.withColumn("lone", lone).filter("take > lone").select("*", F.posexplode(F.expr("slice(own, 1, cast(take - lone as int))")).alias("at", "e"))
    entries = entries.select("centre", "e.token", "id", (F.col("n_diff") - F.col("lone") - F.col("at")).alias("a"), F.col("weight").alias("b"), F.col("slack").alias("c"))
    pairs = written(_candidates(entries, t, True, whole), "near-pairs")
    both = _join_sets(pairs, chosen, chosen, "differences").select("x", "y", "x_set", "y_set").mapInArrow(_overlaps, "x bigint, y bigint, both bigint")
    w = centred.select("id", "weight", "slack")
    near = both.join(w.withColumnsRenamed({"id": "x", "weight": "wx"}), "x").join(w.select(F.col("id").alias("y"), F.col("weight").alias("wy")), "y")
    near = near.filter(F.lit(t.both) * F.col("both") >= F.col("wx") + F.col("wy") - F.col("slack")).select("x", "y")

    # over shingles, rarest first, for sets of different centres
    place = sets_by_id.select("id", "tokens").join(chosen.select("id", "centre"), "id", "left").withColumn("centre", F.coalesce("centre", "id"))
    packs, packs_path = _packed(place)
    sent = packs.mapInArrow(_send_tokens(buckets), "bucket int, pack bigint, hashes binary, counts binary").repartition(parts, "bucket")
    counted = sent.groupBy("bucket").applyInArrow(_counted, "pack bigint, bucket int, counts binary")
    counted = counted.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias("counted"))  # of one pack, so bounded by it
    entries = packs.join(counted.hint("shuffle_hash"), "pack").mapInArrow(_prefix_entries(t), "token bigint, id bigint, a bigint, b bigint, c bigint")
    pairs = written(_candidates(written(entries, "entries"), t, False), "far-pairs")
    discard(spark, packs_path)
    both = _join_sets(pairs, sets, sets, "tokens").select("x", "y", "x_set", "y_set").mapInArrow(_overlaps, "x bigint, y bigint, both bigint")
    n = sets.select("id", "n")
    far = both.join(n.withColumnsRenamed({"id": "x", "n": "nx"}), "x").join(n.withColumnsRenamed({"id": "y", "n": "ny"}), "y")
    far = far.filter(F.lit(den) * F.col("both") >= F.lit(num) * (F.col("nx") + F.col("ny") - F.col("both"))).select("x", "y")
    links = written(direct.unionByName(near).unionByName(far).distinct(), "links")
    return every.select("id", *sig), classes, links, certain


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, ids, centres, sets, held = TaskContext.get().partitionId() << 32, [], [], [], 0

    def pack() -> pa.RecordBatch:
        sizes = np.fromiter((len(s) // 8 for s in sets), np.int64, len(sets))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in (np.array(ids, np.int64).tobytes(), np.array(centres, np.int64).tobytes(), sizes.tobytes(), b"".join(sets)))], ["pack", "ids", "centres", "sizes", "tokens"])

    for batch in batches:
        for i, raw, centre in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if sets and held + len(raw) > PACK_BYTES:
                yield pack()
                number, ids, centres, sets, held = number + 1, [], [], [], 0
            ids.append(i)
            centres.append(centre)
            sets.append(raw)
            held += len(raw)
    if sets:
        yield pack()


def _packed(place: DataFrame) -> tuple[DataFrame, str]:
    """place(id, tokens, centre) in packs of sets, bucketed by pack, and where they lie."""
    spark = place.sparkSession
    path = scratch(spark, "packs")
    rows = place.select("id", "tokens", "centre").mapInArrow(_packs, "pack bigint, ids binary, centres binary, sizes binary, tokens binary")
    rows.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "pack").option("path", path).saveAsTable(table_name(path))
    return spark.table(table_name(path)), path


def _spans(h: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of sorted hashes."""
    cut = np.searchsorted(h, np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)).tolist()
    return [(b, s, e) for b, (s, e) in enumerate(zip(cut, [*cut[1:], len(h)], strict=True)) if s < e]


def _send_tokens(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, n = np.unique(np.frombuffer(row["tokens"], np.uint64), return_counts=True)
                spans = _spans(h, buckets)
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in spans], pa.int32()), pa.array([row["pack"]] * len(spans), pa.int64()), pa.array([h[s:e].tobytes() for _, s, e in spans], pa.binary()), pa.array([n[s:e].astype(np.int32).tobytes() for _, s, e in spans], pa.binary())], ["bucket", "pack", "hashes", "counts"])

    return run


def _counted(rows: pa.Table) -> pa.Table:
    """For each pack in how many sets each of its hashes is, in the order they were sent."""
    parts = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
    h = np.concatenate(parts)
    n = np.concatenate([np.frombuffer(x, np.int32) for x in rows.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(h, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    total = np.empty(len(h), np.int64)
    total[order] = np.repeat(np.add.reduceat(n[order], heads), np.diff(np.append(heads, len(h))))
    ends = np.cumsum([len(p) for p in parts]).tolist()
    return pa.table({"pack": rows.column("pack"), "bucket": rows.column("bucket"), "counts": pa.array([total[s:e].tobytes() for s, e in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())})


def _prefix_entries(t: Threshold):
    """Of each set the tokens that a linked set must share one of, rarest first; those of no other set are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                flat = np.frombuffer(row["tokens"], np.uint64)
                h, where = np.unique(flat, return_inverse=True)
                df = np.concatenate([np.frombuffer(c["counts"], np.int64) for c in row["counted"]])[where]
                out, start = [], 0
                for i, c, n in zip(np.frombuffer(row["ids"], np.int64).tolist(), np.frombuffer(row["centres"], np.int64).tolist(), np.frombuffer(row["sizes"], np.int64).tolist(), strict=True):
                    own, held = flat[start : start + n], df[start : start + n]
                    start += n
                    first = np.lexsort((own, held))[: n - int(t.least_of_self(n)) + 1]
                    at = np.flatnonzero(held[first] > 1)
                    if len(at):
                        out.append((own[first[at]].view(np.int64), np.full(len(at), i), at, np.full(len(at), n), np.full(len(at), c)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["token", "id", "a", "b", "c"])

    return run


def _longs(column: str):
    """A binary of little-endian 64-bit words as an array of their (signed) values."""

    @F.pandas_udf("array<bigint>")
    def words(raw):
        return raw.map(lambda x: np.frombuffer(x, np.int64))

    return words(F.col(column))


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """One row a document: id, n_shingles, class_id (smallest id with an equal set), component_id; with
    count_links also n_links, the number of other classes whose set its own is linked to."""
    documents, classes, links, certain = similar_sets(docs, words, num, den, id_col, text_col, count_links)
    placed = documents.join(classes, ["sig_a", "sig_b", "n"], "left")
    if count_links:
        one = F.lit(1).cast("bigint").alias("n_links")
        ends = links.select(F.col("x").alias("id"), one).union(links.select("y", one)).union(certain)
        counts = ends.groupBy(F.col("id").alias("class")).agg(F.sum("n_links").alias("n_links"))
        placed = placed.join(counts, "class", "left").withColumn("n_links", F.when(F.col("id").isNotNull() & F.col("n_links").isNotNull(), F.col("n_links")).otherwise(F.lit(0).cast("bigint")))
    # an id with several texts ties their classes together
    many = placed.filter("class IS NOT NULL").groupBy("id").agg(F.min("class").alias("x"), F.max("class").alias("last")).filter("x < last").select("id", "x")
    if not many.isEmpty():
        tied = placed.join(many, "id").filter("x <> class").select("x", F.col("class").alias("y"))
        links = written(links.unionByName(tied).distinct(), "links")
    labels = components(links).withColumnRenamed("id", "class")
    smallest = labels.join(classes, "class").groupBy("label").agg(F.min("class_id").alias("component"))
    out = placed.join(labels.join(smallest, "label").select("class", "component"), "class", "left")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "class_id", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"), component.alias("component_id"), *(["n_links"] if count_links else []))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), words=4, num=85, den=100)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "class_id")


def op7_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join's number of links: of each document, how many other classes its own is linked to."""
    out = near_duplicates(table(spark, sf_dir, "documents"), words=4, num=85, den=100, count_links=True)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "class_id", "n_links")


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n, min(doc_id) OVER (PARTITION BY CASE WHEN len(s) = 0 THEN [doc_id::VARCHAR, ''] ELSE list_sort(s) END) AS class_id FROM s),
e AS (SELECT doc_id, unnest(s) AS t FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.id, u.y FROM r JOIN u ON r.other = u.x)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(r.other) AS component_id, any_value(n.class_id) AS class_id FROM n JOIN r ON r.id = n.doc_id GROUP BY n.doc_id
"""
#: As above, with the links of each document to other classes counted.
OP7_LINKS_SQL = f"""
WITH RECURSIVE base AS ({OP7_SQL}),
{OP7_SQL[OP7_SQL.index("w AS (SELECT") : OP7_SQL.index(",{nl}r(id, other)".format(nl=chr(10)))]}
SELECT base.*, count(DISTINCT b.class_id) FILTER (b.class_id <> base.class_id) AS n_links
FROM base LEFT JOIN u ON u.x = base.doc_id LEFT JOIN n b ON b.doc_id = u.y GROUP BY ALL
"""

"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Learned in three steps from a bounded sample of labelled rows: (1) document counts of hashed n-grams by
label, summed over tasks, choose the buckets that tell the labels apart (G statistic); (2) each sampled
text gives its n-grams of those buckets by full hash, from which exact counts and their log ratios
come; (3) logistic regression on presence times log ratio. A text is scored by the sum over the
distinct n-grams it holds, so its length alone adds nothing.

Defined cases: null text counts as empty and scores what the bias says; labels that are null, or whose
document is missing or has null text, teach nothing; a document with two labels teaches both; with one
label only every score is the share of that label, and without any it is 0; rows that repeat an id are
scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.llm.common import held_out_column, slices, table, written
from paperlode.llm.ngrams import grams

ORDERS = (4, 5, 6)
#: Labelled rows of label 1 and of label 0 that are learned from at most, but for chance (those with the smallest md5 of their id).
MOST_TOXIC, MOST_OTHER = 2500, 4000
#: Buckets of the first count; G statistic from which an n-gram counts as telling (about 4 sigma; 5 texts of a rare label).
BUCKET_BITS, LEAST_G = 21, 18.0
THRESHOLD = 0.3
_PARTS = 64


def telling(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """G statistic of presence against label, for counts of documents."""
    n, seen = n_pos + n_neg, pos + neg

    def term(o, e):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(o > 0, o * np.log(o / e), 0.0)

    return 2 * (term(pos, seen * n_pos / n) + term(neg, seen * n_neg / n) + term(n_pos - pos, (n - seen) * n_pos / n) + term(n_neg - neg, (n - seen) * n_neg / n))


@dataclass
class NgramModel:
    """Sorted hashes of the n-grams, their weights and the bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.sieve = np.zeros(1 << 18, bool)
        self.sieve[self.hashes >> np.uint32(14)] = True

    def score(self, texts: list[str]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        pairs = [np.zeros(0, np.int64)]
        for owners, begins, hashes in grams(texts, ORDERS) if len(self.hashes) else ():
            for at, h in zip(begins, hashes, strict=True):
                spots = np.flatnonzero(self.sieve[h >> np.uint32(14)])
                found = np.minimum(np.searchsorted(self.hashes, h[spots]), len(self.hashes) - 1)
                known = self.hashes[found] == h[spots]
                owner = owners[np.searchsorted(at, spots[known], "right") - 1]
                pairs.append(owner * len(self.hashes) + found[known])
        pairs = np.unique(np.concatenate(pairs))  # a feature of a text counts once
        if len(pairs):
            total += np.bincount(pairs // len(self.hashes), weights=self.weights[pairs % len(self.hashes)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(rows: list[tuple[int, np.ndarray]], prior: float, rounds: int = 300, rate: float = 0.005, decay: float = 1e-5) -> NgramModel:
    """rows: label and distinct n-gram hashes of a text. prior: share of label 1 among all labelled rows."""
    y = np.array([r[0] for r in rows], np.float64)
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    none = np.zeros(0, np.uint32)
    if not n_pos or not n_neg:
        share = min(max(prior, 1e-9), 1 - 1e-9)
        return NgramModel(none, np.zeros(0), float(np.log(share / (1 - share))))
    flat = np.concatenate([r[1] for r in rows]) if rows else none
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    hashes, col = np.unique(flat, return_inverse=True)
    pos = np.bincount(col, weights=y[row], minlength=len(hashes))
    neg = np.bincount(col, minlength=len(hashes)) - pos
    keep = telling(pos, neg, n_pos, n_neg) >= LEAST_G
    ratio = np.log((pos + 1) / (n_pos + 2)) - np.log((neg + 1) / (n_neg + 2))
    number = np.cumsum(keep) - 1
    used = keep[col]
    row, col, hashes, ratio = row[used], number[col[used]].astype(np.int32), hashes[keep], ratio[keep]
    if not len(hashes):
        return NgramModel(none, np.zeros(0), float(np.log(prior / (1 - prior))))
    by_col = np.argsort(col, kind="stable")
    row_t, col_heads = row[by_col].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(col, minlength=len(hashes)))[:-1]])
    some = np.unique(row)  # texts that hold any of the n-grams
    row_heads = np.searchsorted(row, some)
    w, b = np.zeros(len(hashes)), float(np.log(n_pos / n_neg))
    m, v, mb, vb = np.zeros(len(hashes)), np.zeros(len(hashes)), 0.0, 0.0
    margin = np.empty(len(rows))
    for k in range(1, rounds + 1):  # Adam on the whole sample
        margin.fill(b)
        margin[some] += np.add.reduceat((w * ratio)[col], row_heads)
        miss = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y) / len(rows)
        g = ratio * np.add.reduceat(miss[row_t], col_heads) + decay * w
        gb = miss.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = (1 - 0.999**k) ** 0.5 / (1 - 0.9**k)
        w -= rate * fix * m / (np.sqrt(v) + 1e-10)
        b -= 5 * rate * fix * mb / (np.sqrt(vb) + 1e-10)
    shift = np.log(prior / (1 - prior)) - np.log(n_pos / n_neg)  # back from the sample's shares
    return NgramModel(hashes.astype(np.uint32), w * ratio, float(b + shift))


def distinct_grams(texts: list[str], chosen) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, distinct n-grams that chosen makes of its hashes), in order, one row a text."""
    held, last = [], 0
    for owners, begins, hashes in grams(texts, ORDERS):
        for j, i in enumerate(owners.tolist()):
            if i != last:
                yield last, np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
                held, last = [], i
            held.append(np.unique(chosen(np.concatenate([h[at[j] : at[j + 1]] for at, h in zip(begins, hashes, strict=True)]))))
    if held:
        yield last, np.unique(np.concatenate(held)) if len(held) > 1 else held[0]


def _counted(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bits), np.int32)
        for batch in batches:
            for part in slices(batch, "text"):
                labels = part.column(0).to_pylist()
                for i, own in distinct_grams([t or "" for t in part.column(1).to_pylist()], lambda h: h >> np.uint32(32 - bits)):
                    counts[labels[i], own] += 1
        size = (1 << bits) // _PARTS
        for p in range(_PARTS):
            part = counts[:, p * size : (p + 1) * size]
            if part.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})

    return run


def _summed(bits: int):
    def run(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(r, np.int32).astype(np.int64) for r in rows.column("counts").to_pylist())
        return pa.table({"part": rows.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    return run


def _telling_grams(chosen, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                tells = lambda h: h[chosen.value[h >> np.uint32(32 - bits)]]
                rows = [own.tobytes() for _, own in distinct_grams([t or "" for t in part.column(1).to_pylist()], tells)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["label", "grams"])

    return run


def train_toxicity(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (MOST_TOXIC, MOST_OTHER), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = BUCKET_BITS) -> NgramModel:
    """Learns from about ``most`` labelled rows (of label 1, of label 0) that aren't held out; only that sample of labels is broadcast."""
    spark = docs.sparkSession
    marks = labels.filter(~held_out_column(id_col)).select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    counts = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if not counts:
        return fit([], 0.0)
    h = F.md5(F.col("id").cast("string"))
    u = F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(1 << 52)
    share = F.when(F.col("label") == 1, min(1.0, most[0] / counts.get(1, 1))).otherwise(min(1.0, most[1] / counts.get(0, 1)))
    sample = marks.filter(u < share).distinct()
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    rows = written(texts.join(F.broadcast(sample), "id").select("label", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "labelled")
    found = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r["label"]: r["n"] for r in found}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    prior = counts.get(1, 0) / sum(counts.values())
    if not n_pos or not n_neg:
        return fit([(k, np.zeros(0, np.uint32)) for k in n], prior)
    size = (1 << bits) // _PARTS
    total = np.zeros((2, 1 << bits), np.int64)
    few = rows.coalesce(12)  # a task's counts are 2 * 2^bits integers however few rows it has
    for r in few.mapInArrow(_counted(bits), "part int, counts binary").groupBy("part").applyInArrow(_summed(bits), "part int, counts binary").collect():  # _PARTS rows of fixed size
        total[:, r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["counts"], np.int64).reshape(2, -1)
    chosen = spark.sparkContext.broadcast(telling(total[1].astype(float), total[0].astype(float), n_pos, n_neg) >= LEAST_G)
    grams = rows.mapInArrow(_telling_grams(chosen, bits), "label int, grams binary").collect()  # about sum(most) rows
    taught = sorted((r["label"], bytes(r["grams"])) for r in grams)
    return fit([(k, np.frombuffer(g, np.uint32)) for k, g in taught], prior)


def score_toxicity(docs: DataFrame, model: NgramModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = shared.value.score([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32), pa.int32())], ["id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id bigint, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out_column().alias("held_out"), "score", "predicted")

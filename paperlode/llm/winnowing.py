"""Document fingerprints by winnowing.

Hashes of all k-grams (code points) are rolled over a text; every window of ``window`` consecutive
hashes gives up its smallest, the rightmost of equals, and a k-gram chosen by several windows counts
once. Positions are kept, so two texts that share a passage of k + window - 1 code points share a
fingerprint and know where (the guarantee).

Defined cases: null text counts as empty and has no fingerprint (likeness of two empty sets: 1); a
text shorter than k is one k-gram, padded with U+0000; a text with fewer than ``window`` k-grams is one
window; very long texts go through in pieces. In the neighbour order null ids come first, rows that
repeat an id follow each other by a hash of their text; the last row's next is the first one, so a single
row is its own next. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.llm.common import mix64, table

K, WINDOW = 12, 29
#: Code points that go through numpy at a time.
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)


def _rolled(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of codes[i : i + k] for every i; the last k - 1 are of no use."""
    with np.errstate(over="ignore"):
        level, size, done, out = codes * np.uint64(0xD6E8FEB86659FD93), 1, 0, None
        while True:
            if k & size:  # append this block after the ones taken so far
                power = np.uint64(pow(_BASE, size, 1 << 64))
                if out is None:
                    out = level.copy()
                else:
                    out = out * power
                    out[: len(out) - done] += level[done:]
                done += size
            if size * 2 > k:
                return mix64(out)
            power = np.uint64(pow(_BASE, size, 1 << 64))
            level = level * power + np.concatenate([level[size:], np.zeros(size, np.uint64)])
            size *= 2


def _window_min(keys: np.ndarray, window: int) -> np.ndarray:
    """Smallest of keys[i : i + window]; past the end stands the largest key."""
    size = 1
    while size * 2 <= window:
        keys = np.minimum(keys, np.concatenate([keys[size:], np.full(size, _TOP)]))
        size *= 2
    rest = window - size
    return np.minimum(keys, np.concatenate([keys[rest:], np.full(rest, _TOP)])) if rest else keys


def winnow(texts: list[str], k: int = K, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the chosen hashes (uint64) and their positions, ascending."""
    out: list = [None] * len(texts)
    at, held = [], 0
    for i, text in enumerate(texts):
        if len(text) > 4 * PIECE:
            out[i] = _winnow_long(text, k, window)
            continue
        at.append(i)
        held += len(text)
        if held >= PIECE:
            _winnow_block([texts[j] for j in at], at, out, k, window)
            at, held = [], 0
    if at:
        _winnow_block([texts[j] for j in at], at, out, k, window)
    return out


def _winnow_block(texts: list[str], at: list[int], out: list, k: int, window: int) -> None:
    gap = "\0" * (k + window)
    codes = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(n + len(gap)) - n - len(gap)
    grams = np.where(n > 0, np.maximum(1, n - k + 1), 0)
    hashes = _rolled(codes, k)
    keys = (hashes & ~_LOW) | (_LOW - np.arange(len(codes), dtype=np.uint64))
    usable = np.zeros(len(codes) + 1, np.int8)
    usable[starts] += 1
    usable[starts + grams] -= 1
    keys[np.cumsum(usable[:-1], dtype=np.int8) == 0] = _TOP
    least = _window_min(keys, window)
    windows = np.where(grams > 0, np.maximum(1, grams - window + 1), 0)
    usable[:] = 0
    usable[starts] += 1
    usable[starts + windows] -= 1
    fresh = np.empty(len(codes), bool)
    fresh[0] = True
    np.not_equal(least[1:], least[:-1], out=fresh[1:])
    fresh[starts] = True
    fresh &= np.cumsum(usable[:-1], dtype=np.int8) > 0
    chosen = np.flatnonzero(fresh)
    places = (_LOW - (least[chosen] & _LOW)).astype(np.int64)
    bounds = np.searchsorted(chosen, np.append(starts, len(codes)))
    for j, i in enumerate(at):
        own = places[bounds[j] : bounds[j + 1]]
        out[i] = (hashes[own], own - starts[j])


def _winnow_long(text: str, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The same in pieces that overlap by a window less one and a k-gram less one."""
    hashes, places, step = [], [], 2 * PIECE
    last = len(text) - k + 1 - window
    for s in range(0, last + 1, step):
        part: list = [None]
        _winnow_block([text[s : min(s + step, last + 1) + window + k - 2]], [0], part, k, window)
        h, p = part[0]
        new = p + s > (places[-1][-1] if places else -1)
        hashes.append(h[new])
        places.append(p[new] + s)
    return np.concatenate(hashes), np.concatenate(places)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(hashes: np.ndarray, places: np.ndarray) -> str:
    return hashlib.sha256(hashes.astype("<u8").tobytes() + places.astype("<i8").tobytes()).hexdigest()


def fingerprint_documents(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_chars, hashes and positions of its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = winnow(texts, k, window)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64()))], ["id", "n_chars", "hashes", "positions"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string")).mapInArrow(run, "id bigint, n_chars bigint, hashes array<bigint>, positions array<bigint>")


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as much of the head of another text (or all of that)."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter] if quarter else text


def _deal(docs: DataFrame, runs: int):
    """(run_of, hot): a UDF from (id or 0, whether there is an id, hash of the text) to one of about ``runs``
    runs in the neighbour order, and whether it looks at the hash.

    The bounds of the runs are quantiles of the ids, as integers (ids beyond 2^53 are compared exactly). An id
    that stands at several quantiles, and null, has several runs, which the hashes of the texts tell apart."""
    n = docs.agg(F.count(F.lit(1)).alias("rows"), F.count("id").alias("known")).first()
    nulls = n["rows"] - n["known"]
    first = max(1, round(runs * nulls / n["rows"])) if nulls else 0
    steps = max(1, runs - first)
    quantiles = docs.select("id").approxQuantile("id", [j / steps for j in range(1, steps)], 0.2 / runs) if n["known"] and steps > 1 else []
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    bounds, several = np.unique(np.array([min(max(int(q), low), high) for q in quantiles], np.int64), return_counts=True)
    several[several == 1] = 0  # runs that an id has for itself
    own = first + 1 + np.cumsum(several + 1) - (several + 1)  # first run of each bound's id

    @F.pandas_udf("int")
    def run_of(ids: pd.Series, known: pd.Series, hashes: pd.Series) -> pd.Series:
        ids, share = ids.to_numpy(np.int64), (hashes.to_numpy(np.int64).astype(np.float64) + 2.0**63) / 2.0**64
        piece = lambda m: np.minimum((share * m).astype(np.int64), np.maximum(m - 1, 0))
        out = np.full(len(ids), first, np.int64)
        if len(bounds):
            at = np.searchsorted(bounds, ids, "right") - 1
            later = at >= 0
            at = np.maximum(at, 0)
            inside = np.where((bounds[at] == ids) & (several[at] > 0), piece(several[at]), several[at])
            out = np.where(later, own[at] + inside, out)
        return pd.Series(np.where(known.to_numpy(bool), out, piece(np.full(len(ids), first))).astype(np.int32))

    return run_of, bool(first > 1 or several.any())


def with_next(docs: DataFrame) -> DataFrame:
    """docs(id, text) dealt to partitions in runs of neighbouring ids, sorted: run, own, id, text.

    A run ends with the row that follows it (own = false). Only one id a run reaches the driver, and texts
    are shuffled once; rows alike in id and text stand in one run."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run_of, hot = _deal(docs, 6 * parts)
    h = F.xxhash64("text")
    runs = docs.withColumn("run", run_of(F.coalesce("id", F.lit(0)), F.col("id").isNotNull(), h if hot else F.lit(0).cast("bigint")))
    firsts = {r["run"]: r["first"] for r in runs.groupBy("run").agg(F.min("id").alias("first")).collect()}  # a row a run
    order = sorted(firsts)
    before = {run: order[j - 1] for j, run in enumerate(order)}

    @F.pandas_udf("int")
    def follows(ids: pd.Series, known: pd.Series, run: pd.Series) -> pd.Series:
        """The run before, for rows with the first id of a run; -1 for all others."""
        leads = (not k or firsts[r] == i for i, k, r in zip(ids.tolist(), known.tolist(), run.tolist(), strict=True))
        return pd.Series([before[r] if lead else -1 for r, lead in zip(run.tolist(), leads, strict=True)], dtype="int32")

    leading = runs.withColumn("before", follows(F.coalesce("id", F.lit(0)), F.col("id").isNotNull(), F.col("run"))).filter("before >= 0")
    leading = leading.groupBy("before", "id").agg(F.min(F.struct(h.alias("h"), F.col("text"))).alias("f"))
    dealt = runs.select("run", F.lit(True).alias("own"), "id", "text").union(leading.select("before", F.lit(False), "id", "f.text"))
    return dealt.repartition(parts, "run").sortWithinPartitions("run", F.desc("own"), F.asc_nulls_first("id"), h, "text")


def _compare(k: int, window: int, edited_marks: bool):
    lists = pa.list_(pa.int64())
    fields = [("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("hashes", lists), ("positions", lists)]
    fields += [("edited_hashes", lists), ("edited_positions", lists)] if edited_marks else []
    schema = pa.schema(fields)

    def block(rows: list) -> pa.RecordBatch:
        """rows and, as the last one, what follows them."""
        pairs = [(j, j + 1) for j in range(len(rows) - 1) if rows[j][1] and rows[j][0] == rows[j + 1][0]]
        plain = winnow([r[3] for r in rows], k, window)
        changed = [edited(rows[a][3], rows[b][3]) for a, b in pairs]
        found = winnow(changed, k, window)
        sets = [np.unique(h) for h, _ in plain]
        out = []
        for (a, b), text, mark in zip(pairs, changed, found, strict=True):
            row = (rows[a][2], len(rows[a][3]), hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), digest(*plain[a]), digest(*mark), likeness(sets[a], np.unique(mark[0])), likeness(sets[a], sets[b]), plain[a][0].view(np.int64), plain[a][1])
            out.append((*row, mark[0].view(np.int64), mark[1]) if edited_marks else row)
        return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            cols = [batch.column(j) for j in range(4)]
            for s in range(0, batch.num_rows, 256):
                for r in zip(*(c.slice(s, 256).to_pylist() for c in cols), strict=True):
                    rows.append((r[0], r[1], r[2], r[3] or ""))
                    held += len(rows[-1][3])
                    if held >= 2 * PIECE and len(rows) > 1:
                        yield block(rows)
                        rows, held = rows[-1:], len(rows[-1][3])
        yield block(rows)

    spelled = {pa.int64(): "bigint", pa.string(): "string", pa.float64(): "double", lists: "array<bigint>"}
    return run, ", ".join(f"{f.name} {spelled[f.type]}" for f in schema)


def compare_neighbours(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", edited_marks: bool = False) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document.

    hashes and positions (code points) are the fingerprint itself, with edited_marks also of the edited
    text; fingerprint and edited_fingerprint are SHA-256 digests of both."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    run, schema = _compare(k, window, edited_marks)
    return with_next(docs).mapInArrow(run, schema)


def op5_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

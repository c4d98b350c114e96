"""Removal of passages that repeat across documents, by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also begins in a document with a smaller id.
Every such string picks an anchor, the (rightmost) smallest hash of its k-grams, and a key, the hash of the
anchor and of the bytes beside it that lie within the string whichever side they are on. Equal strings
pick equal keys, so strings only have to be compared inside buckets of keys:

1. Texts are packed into blocks, written once as a table bucketed by block, so later joins leave it in
   place. A text that equals one with a smaller id (by SHA-256) goes whole and is left out of what
   follows: whatever repeats it repeats the other as well.
2. Blocks send the distinct keys they hold to hash buckets, which answer with those that more than one
   document has, and with those among them that very many places have (hot).
3. Blocks send the stretches of text under shared keys, equal ones once with the smallest id that has them.
   Under a hot key each string is a stretch of its own, dealt by its own hash, so that the differing ends
   of a passage that many documents share scatter over all buckets. A bucket sorts the strings of stretches
   that differ by a blockwise suffix array (see suffix_array) and finds, for every string, the smallest id.
4. Blocks take the smallest ids of their stretches and cut every place whose own id is larger.

There are as many buckets as the bytes of the input ask for, so what a bucket or a block holds is
bounded; a passage that many documents share reaches a bucket once a block.

Defined cases: null text counts as empty; texts under ``length`` bytes lose nothing; a null id counts
as larger than all others; rows that repeat an id don't count against each other; very long texts are
blocks of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.llm.blocks import NO_ID, blocked, total_bytes, unpacked
from paperlode.llm.common import buckets_for, join_by_key, mix64, ragged, table, written
from paperlode.llm.suffix_array import big_endian_words, equal_prefix, sorted_suffixes

LENGTH, K = 50, 16
#: Hash buckets are at least this many times the shuffle partitions.
BUCKETS = 8
#: A key is hot from this many places on, or from those that fill a quarter of a bucket.
HOT = 2048
#: Bytes of stretches that are sorted by one suffix array; more only if one key has more.
SORT_BYTES = 1 << 21
#: Bytes that go through numpy at a time when anchors are chosen; stretches when their bytes are gathered.
PIECE, GATHER = 1 << 18, 1 << 16
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15
#: Told apart by these: keys with the bytes after the anchor, keys of single strings.
_AFTER, _SINGLE = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)


def _rolled(text: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size a hash of text[i : i + size] for every i; the last size - 1 are of no use."""
    with np.errstate(over="ignore"):
        level, size, levels = text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 1, []
        while size <= max(sizes):
            levels.append(level)
            level = level * np.uint64(pow(_BASE, size, 1 << 64)) + np.concatenate([level[size:], np.zeros(min(size, len(level)), np.uint64)])[: len(level)]
            size *= 2
        out = []
        for wanted in sizes:
            acc, done = np.zeros(len(text), np.uint64), 0
            for bit, level in enumerate(levels):
                if wanted >> bit & 1:
                    acc = acc * np.uint64(pow(_BASE, 1 << bit, 1 << 64))
                    acc[: max(0, len(acc) - done)] += level[done:]
                    done += 1 << bit
            out.append(mix64(acc))
        return out


def stretches(text: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = K, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one key: where a run begins, how many strings it has, the key.

    text: documents one after the other; ends: where each ends; skip: documents left out. Strings never
    reach over an end. With ``half`` bytes or more of the string before the anchor the key takes in the half
    before it, else the half after it."""
    window = length - k + 1
    half = window // 2
    begins = np.concatenate([[0], ends[:-1]])
    allowed = np.zeros(len(text) + 1, np.int8)  # a document has ends - begins - length + 1 strings
    long = ends - begins >= length
    if skip is not None:
        long[skip] = False
    allowed[begins[long]] += 1
    allowed[ends[long] - length + 1] -= 1
    allowed = np.cumsum(allowed, dtype=np.int8) > 0
    out = []
    for s in range(0, len(text), PIECE):
        part = text[s : s + PIECE + length]
        n = min(PIECE, len(text) - s)
        ok = allowed[s : s + n]
        if not ok.any():
            continue
        hashes, wider = _rolled(part, k, k + half)
        least = (hashes & ~_LOW) | (_LOW - np.arange(len(part), dtype=np.uint64))
        size = 1
        while size < window:
            step = min(size, window - size)
            least = np.minimum(least, np.concatenate([least[step:], np.full(min(step, len(least)), _TOP)]))
            size += step
        anchor = (_LOW - (least[:n] & _LOW)).astype(np.int64)
        before = anchor - np.arange(n) >= half
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (before[1:] != before[:-1]) | ~ok[:-1]
        new[begins[np.searchsorted(begins, s) : np.searchsorted(begins, s + n)] - s] = True
        heads = np.flatnonzero(new | ~ok)
        sizes = np.diff(np.append(heads, n))
        good = ok[heads]
        heads, sizes = heads[good], sizes[good]
        at, first = anchor[heads], before[heads]
        out.append((heads + s, sizes, np.where(first, wider[np.where(first, at - half, 0)], wider[np.where(first, 0, at)] ^ _AFTER)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _gathered(text: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """text[at : at + size] of many stretches, some at a time: which, bytes (zeros follow) and whether they count."""
    width = -(-int(sizes.max(initial=1)) // 8) * 8
    for s in range(0, len(at), GATHER):
        own = slice(s, s + GATHER)
        inside = np.arange(width)[None, :] < sizes[own, None]
        places = np.minimum(at[own, None] + np.arange(width)[None, :], len(text) - 1)
        yield own, np.where(inside, text[places], np.uint8(0)), inside


def _content(text: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each stretch."""
    out = np.zeros(len(at), np.uint64)
    for own, raw, _ in _gathered(text, at, sizes):
        words = raw.view("<u8")
        with np.errstate(over="ignore"):
            acc = sizes[own].astype(np.uint64)
            for j in range(words.shape[1]):
                acc = np.where(sizes[own] > 8 * j, mix64(acc * np.uint64(_BASE) + words[:, j]), acc)  # whatever the others' sizes
        out[own] = acc
    return out


def _spans(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of sorted keys."""
    cut = np.searchsorted(keys, np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)).tolist()
    return [(b, s, e) for b, (s, e) in enumerate(zip(cut, [*cut[1:], len(keys)], strict=True)) if s < e]


def _copies_of(row: dict) -> np.ndarray:
    """Places in the block of texts that equal one with a smaller id."""
    if not row["copies"]:
        return np.zeros(0, np.int64)
    ids, _, ends, text = unpacked(row)
    raw, first = text.tobytes(), {bytes(c["digest"]): c["first"] for c in row["copies"]}
    lengths = {c["n_bytes"] for c in row["copies"]}
    out = []
    for j, (i, s, e) in enumerate(zip(ids.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
        if e - s in lengths and first.get(hashlib.sha256(raw[s:e]).digest(), i) < i:
            out.append(j)
    return np.array(out, np.int64)


def _send_texts(length: int):
    """Of each different text of a block its digest, length, smallest and largest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, _, ends, text = unpacked(row)
                raw, held = text.tobytes(), {}
                for i, s, e in zip(ids.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    if e - s >= length:
                        own = held.setdefault(hashlib.sha256(raw[s:e]).digest(), [e - s, i, i])
                        own[1], own[2] = min(own[1], i), max(own[2], i)
                if held:
                    columns = zip(*held.values(), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([row["block"]] * len(held), pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], ["digest", "block", "n_bytes", "low", "high"])

    return run, "digest binary, block bigint, n_bytes bigint, low bigint, high bigint"


def _copied(blocks: DataFrame, length: int) -> DataFrame:
    """block, copies: of its texts that equal one with a smaller id, the digest, the length and that id."""
    run, schema = _send_texts(length)
    sent = written(blocks.mapInArrow(run, schema), "texts")
    held = sent.groupBy("digest").agg(F.min("low").alias("first"), F.max("high").alias("last"), F.count(F.lit(1)).alias("held"))
    found = join_by_key(sent, written(held.filter("first < last"), "copied-texts"), ["digest"], "held", sent.count())
    found = found.filter("first < high").groupBy("block")
    return written(found.agg(F.collect_list(F.struct("digest", "n_bytes", "first")).alias("copies")), "copies")  # of one block, so bounded by it


def _send_keys(buckets: int, length: int, k: int):
    """Distinct keys of a block, each with a code: twice the binary logarithm (up) of its places, and whether
    several documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, _, ends, text = unpacked(row)
                at, _, h = stretches(text, ends, length, k, _copies_of(row))
                if not len(h):
                    continue
                owner = ids[np.searchsorted(ends, at, "right")]
                order = np.argsort(h, kind="stable")
                h, owner = h[order], owner[order]
                heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                several = np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads)
                places = np.ceil(np.log2(np.diff(np.append(heads, len(h))))).astype(np.uint8)
                h, code = h[heads], (places * 2 + several).astype(np.uint8)
                spans = _spans(h, buckets)
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in spans], pa.int32()), pa.array([row["block"]] * len(spans), pa.int64()), pa.array([h[s:e].tobytes() for _, s, e in spans], pa.binary()), pa.array([code[s:e].tobytes() for _, s, e in spans], pa.binary())], ["bucket", "block", "hashes", "codes"])

    return run, "bucket int, block bigint, hashes binary, codes binary"


def _shared_keys(hot_from: int):
    """For each block those of its keys that another document has as well, hot ones apart."""

    def run(rows: pa.Table) -> pa.Table:
        blocks = rows.column("block").to_pylist()
        parts = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
        h = np.concatenate(parts)
        code = np.concatenate([np.frombuffer(x, np.uint8) for x in rows.column("codes").to_pylist()])
        order = np.argsort(h, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        sizes = np.diff(np.append(heads, len(h)))
        shared = (sizes > 1) | (np.bitwise_or.reduceat(code[order], heads) & 1 == 1)
        places = np.add.reduceat(np.int64(1) << (code[order] >> 1).astype(np.int64), heads)
        kind = np.empty(len(h), np.int8)  # 0: of one document, 1: shared, 2: hot
        kind[order] = np.repeat(np.where(shared, np.where(places >= hot_from, 2, 1), 0), sizes)
        out, start = [], 0
        for block, part in zip(blocks, parts, strict=True):
            own = kind[start : start + len(part)]
            start += len(part)
            if own.any():
                out.append((block, part[own == 1].tobytes(), part[own == 2].tobytes()))
        return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "shared": pa.array([x[1] for x in out], pa.binary()), "hot": pa.array([x[2] for x in out], pa.binary())})

    return run, "block bigint, shared binary, hot binary"


class _Stretches:
    """The stretches of a block under shared keys: every occurrence (at, strings, owner, number) and the
    different ones by number, in the order of their keys (key, content, size, first, low, high)."""

    def __init__(self, row: dict, length: int, k: int):
        ids, _, ends, self.text = unpacked(row)
        at, count, key = stretches(self.text, ends, length, k, _copies_of(row))
        known = lambda name: np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(s[name], np.uint64) for s in row["keys"])]))

        def among(keys: np.ndarray) -> np.ndarray:
            return keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key if len(keys) else np.zeros(len(key), bool)

        shared, hot = among(known("shared")), among(known("hot"))
        single = ragged(at[hot], count[hot])
        at, count = np.concatenate([at[shared], single]), np.concatenate([count[shared], np.ones(len(single), np.int64)])
        sizes = count + length - 1
        content = _content(self.text, at, sizes)
        key = np.concatenate([key[shared], mix64(content[len(content) - len(single) :] ^ _SINGLE)])
        order = np.lexsort((content, key))
        key, content = key[order], content[order]
        self.at, self.count = at[order], count[order]
        self.owner = ids[np.searchsorted(ends, self.at, "right")]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        heads = np.flatnonzero(new)
        self.number = np.cumsum(new) - 1
        self.key, self.content, self.first, self.size = key[heads], content[heads], self.at[heads], sizes[order][heads]
        self.low = np.minimum.reduceat(self.owner, heads) if len(heads) else self.owner
        self.high = np.maximum.reduceat(self.owner, heads) if len(heads) else self.owner


def _send_stretches(buckets: int, length: int, k: int):
    names = ["bucket", "block", "keys", "contents", "sizes", "bytes", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = _Stretches(row, length, k)
                if not len(own.key):
                    continue
                raw = np.concatenate([r[inside] for _, r, inside in _gathered(own.text, own.first, own.size)])
                ends = np.concatenate([[0], np.cumsum(own.size)])
                spans = _spans(own.key, buckets)
                packed = lambda x: pa.array([x[s:e].tobytes() for _, s, e in spans], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in spans], pa.int32()), pa.array([row["block"]] * len(spans), pa.int64()), packed(own.key), packed(own.content), packed(own.size.astype(np.uint16)), pa.array([raw[ends[s] : ends[e]].tobytes() for _, s, e in spans], pa.binary()), packed(own.low), packed(own.high)], names)

    return run, "bucket int, block bigint, keys binary, contents binary, sizes binary, bytes binary, low binary, high binary"


def smallest_ids(text: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray, low: np.ndarray, length: int) -> np.ndarray:
    """For each string of different stretches, one after the other, the smallest id of an equal string.

    Stretches come in the order of their keys: text[begin : begin + size] with smallest id low. Those of several
    keys are sorted at a time, up to SORT_BYTES; those alone with their key have no equal elsewhere."""
    strings = size - length + 1
    out = np.repeat(low, strings)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    alone = new & np.concatenate([new[1:], [True]])
    places = np.cumsum(strings) - strings
    mixed = np.flatnonzero(~alone)
    # cut the mixed stretches after SORT_BYTES, but never inside a key
    turn = np.cumsum(size[mixed]) // SORT_BYTES
    heads = np.maximum.accumulate(np.where(new[mixed], np.arange(len(mixed)), 0))
    turn = turn[heads] if len(mixed) else turn
    for own in np.split(mixed, np.flatnonzero(np.diff(turn)) + 1):
        if not len(own):
            continue
        flat = text[ragged(begin[own], size[own])]
        starts = np.cumsum(size[own]) - size[own]
        at = ragged(starts, strings[own])
        place_id = np.full(len(flat), NO_ID)
        place_id[at] = np.repeat(low[own], strings[own])
        words = big_endian_words(flat)
        for order in sorted_suffixes(flat, at, words):
            firsts = np.flatnonzero(~equal_prefix(flat, order, length, words))
            least = np.minimum.reduceat(place_id[order], firsts)
            place_id[order] = np.repeat(least, np.diff(np.append(firsts, len(order))))
        out[ragged(places[own], strings[own])] = place_id[at]
    return out


def _answer(length: int):
    """For each block, of its stretches that lose something, runs of strings with one smallest id."""

    def run(rows: pa.Table) -> pa.Table:
        blocks, bucket = rows.column("block").to_pylist(), rows.column("bucket")[0].as_py()
        flat = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
        key, content, low, high = flat("keys", np.uint64), flat("contents", np.uint64), flat("low", np.int64), flat("high", np.int64)
        size, text = flat("sizes", np.uint16).astype(np.int64), flat("bytes", np.uint8)
        begin = np.cumsum(size) - size
        row_ends = np.cumsum([len(x) // 2 for x in rows.column("sizes").to_pylist()])
        order = np.lexsort((content, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
        heads = np.flatnonzero(new)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        lead = order[heads]
        least = smallest_ids(text, begin[lead], size[lead], key[lead], np.minimum.reduceat(low[order], heads), length)
        strings = size[lead] - length + 1
        first = np.cumsum(strings) - strings
        asked = np.flatnonzero(np.minimum.reduceat(least, first)[number] < high)
        n = strings[number[asked]]
        found, of = least[ragged(first[number[asked]], n)], np.repeat(asked, n)
        turns = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (found[1:] != found[:-1])])) if len(of) else np.zeros(0, np.int64)
        of_run, count, ids = of[turns], np.diff(np.append(turns, len(of))).astype(np.uint16), found[turns]
        cuts = np.searchsorted(of_run, row_ends).tolist()
        out = []
        for block, start, s, e in zip(blocks, [0, *row_ends[:-1].tolist()], [0, *cuts[:-1]], cuts, strict=True):
            if s < e:
                out.append((block, bucket, (of_run[s:e] - start).astype(np.int32).tobytes(), count[s:e].tobytes(), ids[s:e].tobytes()))
        kinds = [("block", pa.int64()), ("bucket", pa.int32()), ("index", pa.binary()), ("count", pa.binary()), ("ids", pa.binary())]
        return pa.table({name: pa.array([r[j] for r in out], t) for j, (name, t) in enumerate(kinds)})

    return run, "block bigint, bucket int, index binary, count binary, ids binary"


def _gone(row: dict, buckets: int, length: int, k: int) -> np.ndarray:
    """Which bytes of a block go, by the answers of the buckets."""
    own = _Stretches(row, length, k)
    start = {b: s for b, s, _ in _spans(own.key, buckets)}
    strings = own.size - length + 1
    first = np.cumsum(strings) - strings
    least = np.full(int(strings.sum()), NO_ID)
    for a in row["answers"]:
        index = np.frombuffer(a["index"], np.int32).astype(np.int64) + start[a["bucket"]]
        count, ids = np.frombuffer(a["count"], np.uint16).astype(np.int64), np.frombuffer(a["ids"], np.int64)
        upto = np.cumsum(count) - count
        heads = np.concatenate([[True], index[1:] != index[:-1]])
        inside = upto - np.maximum.accumulate(np.where(heads, upto, 0))  # strings of the stretch before the run
        least[ragged(first[index] + inside, count)] = np.repeat(ids, count)
    smaller = least[ragged(first[own.number], own.count)] < np.repeat(own.owner, own.count)
    places = ragged(own.at, own.count)[smaller]
    step = np.zeros(len(own.text) + 1, np.int8)  # a place begins one string, and one ends there
    step[places] += 1
    step[places + length] -= 1
    return np.cumsum(step[:-1], dtype=np.int64) > 0


def _cut(buckets: int, length: int, k: int, texts: bool):
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if texts else [])]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, known, ends, text = unpacked(row)
                gone = _gone(row, buckets, length, k) if row["answers"] else np.zeros(len(text), bool)
                for j in _copies_of(row).tolist():
                    gone[ends[j - 1] if j else 0 : ends[j]] = True
                out = []
                for i, ok, s, e in zip(ids.tolist(), known.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    own = gone[s:e]
                    kept = text[s:e][~own].tobytes()
                    spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(e > s and own[0])
                    out.append((i if ok else None, e - s, int(own.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t, _ in zip(zip(*out, strict=True), kinds, names, strict=False)], names)

    return run, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept_text binary" if texts else "")


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans, kept_sha256 and, if texts, the kept bytes."""
    if not 1 <= k <= length <= 64:
        raise ValueError("k must be length at most, and length 64 at most")
    spark = docs.sparkSession
    blocks, _ = blocked(docs, id_col, text_col)
    n_bytes = total_bytes(blocks)
    buckets, parts = buckets_for(spark, n_bytes, BUCKETS)
    hot_from = max(HOT, n_bytes // buckets // (4 * 100))  # a stretch takes about 100 bytes
    blocks = blocks.join(_copied(blocks, length).hint("shuffle_hash"), "block", "left")
    run, schema = _send_keys(buckets, length, k)
    sent = blocks.mapInArrow(run, schema).repartition(parts, "bucket")
    run, schema = _shared_keys(hot_from)
    shared = sent.groupBy("bucket").applyInArrow(run, schema)
    shared = shared.groupBy("block").agg(F.collect_list(F.struct("shared", "hot")).alias("keys"))  # of one block, so bounded by it
    blocks = blocks.join(written(shared, "shared").hint("shuffle_hash"), "block", "left")
    run, schema = _send_stretches(buckets, length, k)
    sent = blocks.filter("keys IS NOT NULL").mapInArrow(run, schema).repartition(parts, "bucket")
    run, schema = _answer(length)
    answers = sent.groupBy("bucket").applyInArrow(run, schema)
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "index", "count", "ids")).alias("answers"))
    run, schema = _cut(buckets, length, k, texts)
    return blocks.join(answers.hint("shuffle_hash"), "block", "left").mapInArrow(run, schema)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False).withColumnRenamed("id", "doc_id")

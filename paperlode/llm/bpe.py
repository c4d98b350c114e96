"""BPE encoding and decoding in batched numpy merge rounds.

Words are cut by the byte-level pattern; the symbols of all words not met before lie in one flat
array. A round looks every adjacent pair up by binary search over the sorted pair keys, takes each
word's lowest rank and merges all its occurrences (leftmost first); words without a known pair leave.
Long words don't go through rounds over all their symbols: their live pairs are filed by rank, and a round
takes the places of one rank only and files the pairs it makes. Encoded words are remembered by a
table bounded in words and bytes. Decoding gathers the bytes of all ids at once.

Defined cases: null text counts as empty (no ids, empty decoded text); special tokens in a text become
their id; very long texts are cut at ends of words, so a piece holds more than PIECE code points only
where one word does; rows that repeat an id
are encoded each; an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.llm.common import ragged, table

#: The byte-level pattern of public tokenizers (fixed value); words() cuts as it does.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a worker remembers, bytes of them, and code points encoded at a time.
MOST_WORDS, MOST_BYTES, PIECE = 300_000, 1 << 25, 1 << 19
#: Bytes from which a word is merged by ranks filed apart.
LONG_WORD = 512
_NONE = np.iinfo(np.int32).max
#: Kinds of code points; _END stands between two texts.
_LETTER, _NUMBER, _SPACE, _OTHER, _END = range(5)
_END_CODE = 0x110000


def _kinds() -> np.ndarray:
    out = np.full(_END_CODE + 1, _OTHER, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, _END_CODE)))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out[_END_CODE] = _END
    return out


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte, by the published rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Arrays of a byte-level BPE file: pair keys (sorted), their ranks and results, bytes of each id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    made = np.array([vocab[a + b] for a, b in pairs], np.int32)
    tokens = [b""] * size
    for token, i in vocab.items():
        tokens[i] = bytes(alphabet[c] for c in token)
    for token, i in special.items():
        tokens[i] = token.encode()
    first = np.zeros(256, np.int32)
    for c, b in alphabet.items():
        first[b] = vocab[c]
    return {"size": size, "keys": keys[order], "ranks": order.astype(np.int32), "made": made[order], "tokens": tokens, "first": first, "special": special}


class _Known(dict):
    """Words by number; a word not met before gets the next one and is noted as new."""

    def __init__(self, *args):
        super().__init__(*args)
        self.new = []

    def __missing__(self, word):
        self[word] = at = len(self)
        self.new.append(word)
        return at


class Encoder:
    def __init__(self, vocabulary: dict):
        self.v = vocabulary
        self.kinds = _kinds()
        # where a word ends whatever stands around: before white space, after letters or numbers, before a number
        self.cut = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}])(?=\p{N})")
        self.reach = max(map(len, vocabulary["special"]), default=0)
        special = sorted(vocabulary["special"], key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.token_len = np.fromiter(map(len, vocabulary["tokens"]), np.int64, vocabulary["size"])
        self.token_start = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(vocabulary["tokens"]), np.uint8)
        self.forget()

    def forget(self) -> None:
        """Starts a new table of words; special tokens are in it under (their id,)."""
        self.known = _Known({(i,): j for j, i in enumerate(self.v["special"].values())})
        self.flat = np.array(list(self.v["special"].values()), np.int32)
        self.lengths = np.ones(len(self.flat), np.int64)
        self.starts = np.arange(len(self.flat), dtype=np.int64)
        self.held = 0

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the sorted pair keys and ranks of pairs; _NONE where a pair is none."""
        v = self.v
        keys = left.astype(np.int64) * v["size"] + right
        at = np.minimum(np.searchsorted(v["keys"], keys), len(v["keys"]) - 1)
        return at, np.where(v["keys"][at] == keys, v["ranks"][at], _NONE)

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word. ``after`` and ``before`` link its live symbols; places of pairs are filed by
        rank, and those that are of another rank by the time it is their turn are passed over."""
        v = self.v
        sym = v["first"][np.frombuffer(word, np.uint8)]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        live = np.ones(n, bool)
        filed: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(places: np.ndarray) -> None:
            places = places[(places >= 0) & (after[np.maximum(places, 0)] < n)]
            _, rank = self.ranks_of(sym[places], sym[after[places]])
            places, rank = places[rank != _NONE], rank[rank != _NONE]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            heads = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if len(rank) else np.zeros(0, np.int64)
            for r, part in zip(rank[heads].tolist(), np.split(places, heads[1:]), strict=False):
                if r not in filed:
                    filed[r] = []
                    heapq.heappush(heap, r)
                filed[r].append(part)

        file(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            spots = np.unique(np.concatenate(filed.pop(r)))
            spots = spots[live[spots]]
            spots = spots[after[spots] < n]
            at, rank = self.ranks_of(sym[spots], sym[after[spots]])
            spots, at = spots[rank == r], at[rank == r]
            if not len(spots):
                continue
            touches = np.concatenate([[False], after[spots[:-1]] == spots[1:]])  # a a a: every second from the left
            index = np.arange(len(spots))
            run = np.maximum.accumulate(np.where(touches, 0, index))
            first = (index - run) % 2 == 0
            spots, at = spots[first], at[first]
            gone = after[spots]
            sym[spots] = v["made"][at]
            live[gone] = False
            after[spots] = after[gone]
            inner = after[spots] < n
            before[after[spots][inner]] = spots[inner]
            file(np.unique(np.concatenate([before[spots], spots])))
        return sym[live]

    def merge_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has."""
        v, n = self.v, len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        sym = v["first"][np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(n, dtype=np.int64), lengths)
        done_sym, done_word = [], []
        while len(sym):
            keys = sym[:-1].astype(np.int64) * v["size"] + sym[1:]
            at = np.minimum(np.searchsorted(v["keys"], keys), len(v["keys"]) - 1)
            rank = np.full(len(sym), _NONE, np.int32)
            rank[:-1] = np.where((v["keys"][at] == keys) & (word[1:] == word[:-1]), v["ranks"][at], _NONE)
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(sym)))
            least = np.repeat(least, sizes)
            finished = least == _NONE
            if finished.any():
                done_sym.append(sym[finished])
                done_word.append(word[finished])
            hit = (rank == least) & ~finished
            twin = np.flatnonzero(hit[1:] & hit[:-1])
            if len(twin):  # overlapping occurrences (a a a): every second one of a run, from its left end
                spots = np.flatnonzero(hit)
                begins = np.concatenate([[True], np.diff(spots) > 1])
                run = np.maximum.accumulate(np.where(begins, spots, -1))
                hit[spots[(spots - run) % 2 == 1]] = False
            left = np.flatnonzero(hit)
            sym[left] = v["made"][at[left]]
            keep = ~finished
            keep[left + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=n).astype(np.int64)

    def learn(self) -> None:
        """Encodes the words that are new in the table."""
        words, self.known.new = [w.encode("utf-8", "replace") for w in self.known.new], []
        long = [j for j, w in enumerate(words) if len(w) >= LONG_WORD]
        flat, lengths = self.merge_rounds([b"" if len(w) >= LONG_WORD else w for w in words])
        if long:
            parts = np.split(flat, np.cumsum(lengths)[:-1])
            for j in long:
                parts[j] = self.merge_long(words[j])
                lengths[j] = len(parts[j])
            flat = np.concatenate(parts)
        self.held += sum(map(len, words))
        self.starts = np.concatenate([self.starts, np.cumsum(lengths) - lengths + len(self.flat)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])

    def pieces(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > 2 * PIECE:
            cut = next((m.start() for m in self.cut.finditer(text, start + PIECE) if not self.inside_special(text, m.start())), None)
            if cut is None:
                break
            yield text[start:cut]
            start = cut
        yield text[start:] if start else text

    def inside_special(self, text: str, place: int) -> bool:
        """Whether a special token that begins before a place ends after it."""
        if not self.special:
            return False
        low = max(0, place - self.reach)
        found = self.special.finditer(text[low : place + self.reach], overlapped=True)
        return any(m.start() < place - low < m.end() for m in found)

    def words(self, parts: list[str]) -> tuple[list[str], np.ndarray]:
        """Words of texts, one after the other, and how many each text has; cut as PATTERN does.

        A run of one kind is a word, with the blank before it if there is one. White space before a
        word leaves its last character to itself; an apostrophe that begins a word takes s, t, m, d,
        re, ve or ll with it.
        """
        joined = "\0".join(parts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        codes[ends] = _END_CODE
        kind = self.kinds[codes]
        start = np.empty(len(codes), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start[1:] |= kind[:-1] == _END
        space = kind == _SPACE
        last = np.flatnonzero(space[:-1] & (kind[1:] < _END) & ~space[1:])  # white space right before a word
        start[last] = True
        start[last[codes[last] == 32] + 1] = False
        marks = np.flatnonzero(codes == 39)
        marks = marks[start[marks]]
        if len(marks):
            one, two = codes[np.minimum(marks + 1, len(codes) - 1)], codes[np.minimum(marks + 2, len(codes) - 1)]
            short = (one == 115) | (one == 116) | (one == 109) | (one == 100)
            long = ((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108))
            for hit, n in ((marks[short], 2), (marks[long], 3)):
                start[hit + 1] = False
                start[hit + n] = True
        at = np.flatnonzero(start)
        at = at[kind[at] < _END]
        stop = np.append(at[1:], len(codes))
        text_of = np.searchsorted(ends, at)
        stop = np.minimum(stop, ends[text_of])
        words = [joined[s:e] for s, e in zip(at.tolist(), stop.tolist(), strict=True)]
        return words, np.bincount(text_of, minlength=len(parts))

    def encode_some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and where each begins (and the last ends)."""
        if len(self.known) > MOST_WORDS or self.held > MOST_BYTES:
            self.forget()
        if self.special and any(self.special.search(t) for t in texts):
            parts, owner, marks = [], [], []
            for i, text in enumerate(texts):
                begin = 0
                for m in self.special.finditer(text):
                    parts.append(text[begin : m.start()])
                    marks.append((len(parts), (self.v["special"][m[0]],)))
                    owner.append(i)
                    begin = m.end()
                parts.append(text[begin:])
                owner.append(i)
            words, counts = self.words(parts)
            places = np.cumsum(counts)
            for part, token in reversed(marks):
                words.insert(int(places[part - 1]), token)
                counts[part - 1] += 1
            counts = np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)
        else:
            words, counts = self.words(texts)
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            self.learn()
        lengths = self.lengths[index]
        ids = self.flat[ragged(self.starts[index], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([self.encode_some([p])[0] for p in self.pieces(text)])

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes_of(ids)[0].tobytes().decode("utf-8", "replace")

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.token_len[ids]
        return self.token_bytes[ragged(self.token_start[ids], lengths)], np.concatenate([[0], np.cumsum(lengths)])


_ENCODERS: dict[str, Encoder] = {}


def _coded(vocabulary, key: str, full: bool):
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if full else [])]

    def emit(rows: list) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], types[j]) for j in range(len(names))], names)

    def row(ident, ids: np.ndarray, raw: bytes) -> tuple:
        text = raw.decode("utf-8", "replace")
        packed = ids.astype("<u4").tobytes()
        return (ident, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), packed, text)

    def some(coder: Encoder, ids: list, texts: list[str]) -> pa.RecordBatch:
        codes, ends = coder.encode_some(texts)
        raw, places = coder.bytes_of(codes)
        spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        return emit([row(i, codes[s:e], raw[places[s] : places[e]].tobytes()) for i, (s, e) in zip(ids, spans, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(vocabulary.value)
        coder = _ENCODERS[key]
        for batch in batches:
            ids, texts, held = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if len(text) > 2 * PIECE:
                    codes = coder.encode(text)
                    yield emit([row(i, codes, coder.bytes_of(codes)[0].tobytes())])
                    continue
                ids.append(i)
                texts.append(text)
                held += len(text)
                if held >= PIECE:
                    yield some(coder, ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield some(coder, ids, texts)

    return run


def encode_documents(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """One row a document: id, n_tokens, ids_sha256, decoded_sha256 and, if full, ids (little-endian
    unsigned 32-bit) and the decoded text. vocabulary: path of a byte-level BPE file; its arrays are
    broadcast, whose size the vocabulary fixes."""
    path = vocabulary or default_vocabulary()
    arrays = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    schema = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if full else "")
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string"))
    return docs.mapInArrow(_coded(arrays, path, full), schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), full=False).withColumnRenamed("id", "doc_id")

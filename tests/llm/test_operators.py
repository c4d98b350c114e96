"""The ten operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperlode.llm import blocks, bpe, exact_dedup, jaccard_join, language_id, mixing, shingles, sharding, suffix_array, suffix_dedup, toxicity, warc, winnowing

DOCS = "doc_id long, text string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema).repartition(3)


def odd_rows():
    """A table with what a corpus may hold at its worst, clashing column names included."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "a b c d e f"), (2, "a  b c\td e f"), (3, None), (4, ""), (5, " \n"), (6, "12 34"), (7, long), (8, long), (2, "a  b c\td e f"), (None, "a b c d e f"), (10, "é漢🙂 \x85x")]
    return [(i, t, None if i == 3 else "src", "en", 0, 0) for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), "doc_id long, text string, source string, lang string, shard int, id int").repartition(2)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, shard int, id int")


# ---- exact dedup


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    out = Counter()
    for i, t in rows:
        g = groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")]
        out[i, min(g)[2], len(g)] += 1
    return out


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(spark, odd, empty, digest_bytes):
    random.seed(1)
    rows = [(i, random.choice(["a b", "ab", "a b", " ab ", "abc", None, "", "x" * 50]) if i % 2 else f"t{i % 90} {i}") for i in range(300)]
    got = exact_dedup.exact_dedup(frame(spark, rows), memtable_rows=20, range_rows=50, digest_bytes=digest_bytes)
    assert Counter((r["id"], r["keep_id"], r["group_size"]) for r in got.collect()) == brute_exact(rows)
    assert Counter(r["keep_id"] for r in got.collect() if r["kept"]) == Counter(k for _, k, _ in {(None, k, n) for _, k, n in brute_exact(rows)})
    if digest_bytes == 32:
        repeats = [(5, "x y"), (5, "xy"), (5, "x  y"), (5, "x  y"), (9, "xy"), (None, "q"), (None, "q "), (None, "q "), (7, "alone"), (7, "other")]
        kept = exact_dedup.exact_dedup(frame(spark, repeats)).filter("kept").collect()
        assert sorted(((r["id"], r["group_size"]) for r in kept), key=str) == [(5, 5), (7, 1), (7, 1), (None, 3)]
        got = exact_dedup.exact_dedup(odd)
        assert Counter((r["id"], r["keep_id"], r["group_size"]) for r in got.collect()) == brute_exact([r[:2] for r in odd_rows()])
        assert exact_dedup.exact_dedup(empty).count() == 0


def test_merge_keeps_smallest():
    words = np.array([[1, 0, 0, 0], [2, 0, 0, 0], [1, 0, 0, 0]], np.uint64)
    a = exact_dedup.Run(words, np.array([5, 1, 5]), np.array([9, 1, 3]), np.array([0, 1, 2]), np.ones(3, np.int64))
    b = exact_dedup.Run(words[[0, 0]], np.array([5, 5]), np.array([2, 2]), np.array([8, 7]), np.ones(2, np.int64))
    m = exact_dedup.merge(a, b, exact_dedup.Bloom(b.words))
    assert m.ids.tolist() == [2, 1] and m.rows.tolist() == [7, 1] and m.counts.tolist() == [4, 1]


# ---- mixing


def test_mixing(spark, odd, empty):
    rows = [(i, f"t{i}", "big" if i % 3 else None if i % 2 else "small") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, target_rows=3000)
    copies = Counter(r["doc_id"] for r in got.collect())
    rates = {r["mix_source"]: r["rate"] for r in mixing.source_rates(docs, "source", None, 0.5, 3000).collect()}

    def poisson(i, source):
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, np.exp(-rates[source])
        c = p
        while c <= u:
            k += 1
            p *= rates[source] / k
            c += p
        return k

    assert copies == Counter({i: n for i, _, s in rows if (n := poisson(i, s))})
    shares = Counter(r["source"] for r in got.collect())
    assert abs(sum(shares.values()) - 3000) < 300 and None in shares
    assert got.columns == ["doc_id", "text", "source", "copy_no", "shuffle_key"]
    only = mixing.mix_sources(docs, weights={"small": 1.0}, target_rows=400).select("source").distinct().collect()
    assert [r[0] for r in only] == ["small"]
    assert mixing.mix_sources(odd, target_rows=50).count() > 10 and mixing.mix_sources(empty).count() == 0
    clash = docs.selectExpr("doc_id", "text", "source", *(f"doc_id * {i} AS {c}" for i, c in enumerate(["rate", "cdf", "first", "mix_source", "own", "ident", "of", "u", "n", "mix_u", "mix_n"], 2)))
    got = mixing.mix_sources(clash, target_rows=3000)
    assert got.columns == [*clash.columns, "copy_no", "shuffle_key"] and Counter(r["doc_id"] for r in got.collect()) == copies
    assert all(r["rate"] == 2 * r["doc_id"] and r["mix_n"] == 12 * r["doc_id"] for r in got.collect())


def test_mixing_large_means(spark):
    docs = spark.createDataFrame([(i, "x", "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    rates = {r["mix_source"]: r for r in mixing.source_rates(docs, "source", None, 0.5, 40_000_000).collect()}
    assert all(len(r["cdf"]) < 24 * r["rate"] ** 0.5 + 100 and r["cdf"] == sorted(r["cdf"]) and r["cdf"][-1] == pytest.approx(1) for r in rates.values())
    got = mixing.mix_sources(docs, target_rows=400_000).groupBy("doc_id").count().collect()
    assert len(got) == 40 and all(abs(r["count"] - 10_000) < 600 for r in got) and len({r["count"] for r in got}) > 20


# ---- sharding


def test_sharding(spark, odd, empty):
    rows = [(i, None if i % 50 == 0 else f"té{i}", "hot" if i % 3 == 0 else f"s{i % 7}" if i % 5 else None) for i in range(1000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    assert len(got) == 1000 and sorted(r["position"] for r in got) == list(range(1000))
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    total = Counter(r["source"] for r in got)
    for source, n in total.items():  # every shard has a source's share, give or take one row
        assert all(abs(sum(r["source"] == source for r in got if r["shard"] == s) - n / 16) <= 2 for s in range(16))
    text = dict((i, t or "") for i, t, _ in rows)
    assert all(r["size"] == len(text[r["id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["id"]].encode()) for r in got)
    # brute force: rank by hash in a source, then order by fractional rank
    h = {i: hashlib.md5(f"shard-1:{i}".encode()).hexdigest() for i, _, _ in rows}
    ranked = []
    for source in total:
        own, name = sorted((h[i], i) for i, _, s in rows if s == source), "n" if source is None else "s" + source
        offset = (int(hashlib.md5(f"shard-1:source:{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        ranked += [((k + offset) / len(own), name, x, i) for k, (x, i) in enumerate(own)]
    assert [i for *_, i in sorted(ranked)] == [r["id"] for r in sorted(got, key=lambda r: r["position"])]
    assert sharding.shard_documents(odd).count() == 11 and sharding.shard_documents(empty).count() == 0


def test_sharding_spreads_small_sources_and_repeats(spark):
    rows = [(i, "t", f"own{i}") for i in range(1500)] + [(None, "same", "hot")] * 1500
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert sorted(r["position"] for r in got) == list(range(3000)) and len({r["frac_rank"] for r in got}) > 2900
    hot = Counter(r["shard"] for r in got if r["source"] == "hot")
    assert len(hot) == 16 and max(hot.values()) < 140 and max(Counter(r["shard"] for r in got).values()) == 188


# ---- BPE


def test_bpe(spark, odd, empty):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    real, coder = Tokenizer.from_file(path), bpe.Encoder(bpe.load_vocabulary(path))
    random.seed(2)
    letters = "abcdeaaaa  \n\t\r\x0b\x1c\x85\xa0é漢ß१२3🙂́'sTl-_., 　​\""
    texts = ["".join(random.choice(letters) for _ in range(random.randrange(50))) for _ in range(3000)] + ["x<|endoftext|> y<|endoftext|>", "a" * 300, "", "it's we'll 'd''s"]
    ids, ends = coder.encode_some(texts)
    for text, s, e, want in zip(texts, ends[:-1], ends[1:], real.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[s:e].tolist() == want.ids, text
        assert coder.decode(ids[s:e]) == real.decode(want.ids, skip_special_tokens=False)
    whole = "word another  one\n" * 2000
    coder.forget()
    old, bpe.PIECE = bpe.PIECE, 1000
    assert coder.encode(whole).tolist() == real.encode(whole, add_special_tokens=False).ids
    bpe.PIECE = old
    got = {r["id"]: r for r in bpe.encode_documents(odd).collect()}
    for i, t, *_ in odd_rows():
        want = np.array(real.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
        assert bytes(got[i]["ids"]) == want and got[i]["ids_sha256"] == hashlib.sha256(want).hexdigest() and got[i]["decoded"] == (t or "")
    assert bpe.encode_documents(empty).count() == 0


def test_bpe_long_words_and_cuts(monkeypatch):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    real, coder = Tokenizer.from_file(path), bpe.Encoder(bpe.load_vocabulary(path))
    random.seed(11)
    for n, letters in ((600, "ab"), (3000, "a"), (20_000, "etaoinshrdlu"), (4000, "abé漢🙂"), (1 << 20, "etaoinshrdluabc")):
        word = "".join(random.choice(letters) for _ in range(n))
        assert coder.encode(word).tolist() == real.encode(word, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "PIECE", 50)  # cuts without a lone blank near, inside special tokens, contractions, white space
    for _ in range(150):
        text = "".join(random.choice(["a", "b", "é", "1", "2", " ", "\n", "'s", "'", "-", "<|endoftext|>", "\t", "  ", "'ll", "漢", "."]) for _ in range(400))
        assert all(len(p) < 1000 for p in coder.pieces(text))
        assert coder.encode(text).tolist() == real.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "MOST_BYTES", 100)
    texts = ["one two three " * 20, "four five"] * 3
    for want in real.encode_batch(texts, add_special_tokens=False)[:2] * 3:
        assert coder.encode(texts[0] if len(want.ids) > 9 else texts[1]).tolist() == want.ids and len(coder.known) < 50


# ---- winnowing


def brute_winnow(text, k, window):
    if not text:
        return []
    grams = [text[i : i + k].ljust(k, "\0") for i in range(max(1, len(text) - k + 1))]
    h = [int(winnowing._rolled(np.array([ord(c) for c in g], np.uint64), k)[0]) for g in grams]
    out = []
    for s in range(max(1, len(h) - window + 1)):
        at = range(s, min(s + window, len(h)))
        low = min(h[i] >> 32 for i in at)
        p = max(i for i in at if h[i] >> 32 == low)
        if not out or out[-1] != p:
            out.append(p)
    return [(h[p], p) for p in out]


def test_winnowing(spark, odd, empty, monkeypatch):
    random.seed(3)
    texts = ["".join(random.choice("ab é") for _ in range(random.choice([0, 1, 5, 11, 12, 13, 40, 41, 200]))) for _ in range(80)]
    for (h, p), t in zip(winnowing.winnow(texts), texts, strict=True):
        assert list(zip(h.tolist(), p.tolist(), strict=True)) == brute_winnow(t, 12, 29)
    long = "".join(random.choice("abcdef ") for _ in range(9000))
    whole = winnowing.winnow([long])[0]
    monkeypatch.setattr(winnowing, "PIECE", 500)
    pieces = winnowing.winnow([long])[0]
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))
    a, b = "x" * 30 + long[:40] + "y" * 30, "z" * 17 + long[:40]
    (ha, pa_), (hb, pb) = winnowing.winnow([a, b])
    assert any(i - 30 == j - 17 and 30 <= i < 70 for h, i in zip(ha.tolist(), pa_.tolist(), strict=True) for g, j in zip(hb.tolist(), pb.tolist(), strict=True) if h == g)
    rows = [(i * 3, "".join(random.choice("abcd ") for _ in range(random.randrange(0, 300)))) for i in range(200)]
    got = {r["id"]: r for r in winnowing.compare_neighbours(frame(spark, rows)).collect()}
    assert len(got) == 200
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        changed = winnowing.edited(t, n)
        assert len(changed) <= len(t) and got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        sets = [set(winnowing.winnow([x])[0][0].tolist()) for x in (t, changed, n)]
        near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert got[i]["near_edited"] == pytest.approx(near(sets[0], sets[1])) and got[i]["near_next"] == pytest.approx(near(sets[0], sets[2]))
        marks = winnowing.winnow([t])[0]
        assert got[i]["hashes"] == marks[0].view(np.int64).tolist() and got[i]["positions"] == marks[1].tolist()
    rows = winnowing.compare_neighbours(odd).collect()
    assert len(rows) == 11 and len({r["fingerprint"] for r in rows if r["id"] in (7, 8)}) == 1
    assert winnowing.compare_neighbours(empty).count() == 0 and winnowing.compare_neighbours(frame(spark, [(1, "a b c d e")])).count() == 1
    assert winnowing.fingerprint_documents(odd).count() == 11
    assert {len(r["edited_hashes"]) == len(r["edited_positions"]) for r in winnowing.compare_neighbours(odd, edited_marks=True).collect()} == {True}


def test_winnowing_large_null_and_hot_ids(spark):
    random.seed(12)
    text = lambda: "".join(random.choice("abcd ") for _ in range(random.randrange(40, 90)))
    rows = [(random.getrandbits(62) - random.getrandbits(62), text()) for _ in range(400)] + [((1 << 62) + i, text()) for i in range(40)] + [(9, text()) for _ in range(300)]
    rows += [(None, text()) for _ in range(300)] + [(9, "twin text")] * 20 + [(-(1 << 63), text()), ((1 << 63) - 1, text())]
    got = winnowing.compare_neighbours(frame(spark, rows)).collect()
    assert Counter(r["id"] for r in got) == Counter(i for i, _ in rows)
    hashed = {t: h for t, h in spark.createDataFrame([(t,) for _, t in rows], "t string").distinct().select("t", F.xxhash64("t")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]], r[1]))
    want = Counter((i, hashlib.sha256(winnowing.edited(t, n).encode()).hexdigest()) for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True))
    assert Counter((r["id"], r["edited_sha256"]) for r in got) == want


# ---- WARC


def test_warc(spark, monkeypatch):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://a/3\nX: y", "\r\n\r\nWARC/1.1"), (4, "u", None), (5, "u", ""), (None, "n", "<p>x</p>"), (7, "é", "é" * 5000), (2, None, "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300)
    folder, index = warc.write_archives(pages)
    got = sorted(((r["id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_records(index, folder).collect()), key=str)
    want = [(1, "revisit", 2, 8), (2, "response", None, 8), (2, "response", None, 8), (3, "response", None, 12), (4, "revisit", 5, 0), (5, "response", None, 0), (7, "response", None, 10000), (None, "revisit", 2, 8)]
    assert got == sorted(want, key=str)
    some = warc.read_records(index.filter("id = 3 AND record_type = 'response'"), folder).collect()
    assert bytes(some[0]["payload"]) == b"\r\n\r\nWARC/1.1" and some[0]["url"] == "http://a/3%0AX:%20y"
    folder, index = warc.write_archives(pages.limit(0))
    assert index.count() == 0 and warc.read_records(index, folder).count() == 0
    folder, index = warc.write_archives(pages, least_bytes=1)
    assert index.filter("id = 4 AND record_type = 'response'").count() == 1
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abc", "A" * 32))


def test_warc_scattered_index_and_lost_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rows = [(i, f"http://a/{i}", f"<p>{i % 40}</p>" if i % 2 else "<p>hot</p>") for i in range(300)]
    folder, index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    path = folder.removeprefix("file://") + "/archives"
    open(f"{path}/lost.warc.gz", "wb").close()
    assert warc.clear_lost(index, folder) == 1 and warc.clear_lost(index, folder) == 0
    last = {p: max(i for i, _, q in rows if q == p) for _, _, p in rows}
    some = index.filter("id % 3 = 0").orderBy(F.rand(1))
    got = {(r["id"], r["refers_to"]) for r in warc.read_records(some, folder).collect()}
    assert got == {(i, None if last[p] == i else last[p]) for i, _, p in rows if i % 3 == 0}


def test_ranges():
    places = [("a", 0, 10), ("a", 10, 10), ("a", 100, 5), ("a", 10_000_000, 5), ("b", 0, 5)]
    assert list(warc.ranges(places)) == [("a", 0, 105, [(0, 10), (10, 10), (100, 5)]), ("a", 10_000_000, 10_000_005, [(10_000_000, 5)]), ("b", 0, 5, [(0, 5)])]


# ---- suffix arrays


def test_suffix_array(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(suffix_array, "BUCKET", 200)
    for _ in range(25):
        n, letters = int(rng.integers(1, 900)), int(rng.choice([1, 2, 3, 50]))
        text = rng.integers(97, 97 + letters, n).astype(np.uint8)
        if n > 300:
            text[150:300] = text[:150]
        raw = text.tobytes()
        places = np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False))
        got = np.concatenate(list(suffix_array.sorted_suffixes(text, places)))
        keys = [raw[p : p + 64].ljust(64, b"\0") for p in got]
        assert sorted(got.tolist()) == places.tolist() and keys == sorted(keys)
        same = suffix_array.equal_prefix(text, got, 50)
        assert same.tolist() == [False] + [len(raw[x : x + 50]) == 50 and raw[x : x + 50] == raw[y : y + 50] for x, y in zip(got[1:], got[:-1], strict=True)]


def brute_repeats(rows, length=50):
    first, order = {}, lambda i: 1 << 63 if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(first.get(b[p : p + length], 1 << 63), order(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < order(i):
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "hot"), [(3, 2048), (4, 3), (5, 1)])
def test_remove_repeats(spark, empty, monkeypatch, seed, hot):
    random.seed(seed)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    passages = ["".join(random.choice("abcdé ") for _ in range(random.choice([49, 50, 51, 60, 120, 300]))) for _ in range(20)]
    rows = [(i, "".join(random.choice(passages) if random.random() < 0.4 else "".join(random.choice("abcdefgh ") for _ in range(random.randrange(80))) for _ in range(random.randrange(8)))) for i in range(150)]
    rows += [(5, rows[5][1]), (None, rows[7][1]), (None, rows[7][1]), (400, None), (401, ""), (402, "ab" * 200), (403, "ab" * 300), (404, "a" * 49), (405, "a" * 50), (406, "a" * 200)]
    monkeypatch.setattr(suffix_dedup, "blocked", lambda d, i, t: blocks.blocked(d, i, t, 3000))
    monkeypatch.setattr(suffix_dedup, "PIECE", 777)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "GATHER", 100)
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute_repeats(rows)
    assert all(hashlib.sha256(bytes(r["kept_text"])).hexdigest() == r["kept_sha256"] for r in got)
    assert suffix_dedup.remove_repeats(empty).count() == 0


# ---- Jaccard join


def words_of(text):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]


def set_of(text, k):
    w = words_of(text)
    return frozenset({tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)})


def brute_components(rows, k, num, den):
    sets = {i: set_of(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), root(i)) for i, s in sets.items())


def test_shingles():
    random.seed(1)
    texts = [None, "", " ", "a", "A b", "a b c d", "a b c d a b c d", "x\x0by z\tq w"] + ["".join(random.choice("aAbé \n") for _ in range(60)) for _ in range(60)]
    got, want = shingles.shingle_sets(pa.array(texts), 4), [set_of(t, 4) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    assert all(len(want[i] & want[j]) == len(np.intersect1d(got[i], got[j])) for i in range(len(texts)) for j in range(i))


def near_rows(n):
    vocabulary = [f"w{i}" for i in range(60)]
    draw = lambda k: [random.choice(vocabulary) for _ in range(k)]

    def edit(words, rate):
        out = []
        for w in words:
            u = random.random()
            out += draw(1) if u < rate / 3 else [] if u < 2 * rate / 3 else [w, *draw(1)] if u < rate else [w]
        return out

    bases, rows = [draw(random.randrange(20, 120)) for _ in range(8)], []
    for i in range(n):
        base, u = random.choice(bases[:2] if random.random() < 0.6 else bases), random.random()
        w = base[: int(len(base) * random.uniform(0.7, 1))] if u < 0.1 else edit(base, random.choice([0, 0.005, 0.01, 0.02, 0.05, 0.1])) if u < 0.75 else draw(random.randrange(60)) + (base[:40] if u < 0.87 else [])
        rows.append((i * 3 + 1, " ".join(w)))
    return rows + [(5000, None), (5002, ""), (5004, " \t"), (5006, "a b"), (5008, "A  b"), (5010, "a c")]


@pytest.mark.parametrize(("k", "num", "chunk"), [(4, 85, 4096), (5, 80, 64)])
def test_jaccard_join(spark, monkeypatch, k, num, chunk):
    random.seed(5)
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rows = near_rows(300)
    got = jaccard_join.near_duplicates(frame(spark, rows), k, num, 100).collect()
    assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, k, num, 100)


@pytest.mark.parametrize(("seed", "chunk"), [(5, 4096), (6, 16)])
def test_jaccard_link_counts(spark, monkeypatch, seed, chunk):
    random.seed(seed)
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rows = near_rows(250)
    base = [f"v{i}" for i in range(100)]  # a group around one centre, with edits alone and in common
    for i in range(60):
        w = list(base)
        for at in random.sample([10, 30, 50, 70, 90], random.randrange(3)) + random.sample(range(100), random.randrange(2)):
            w[at] = random.choice(["x", f"y{i}"])
        rows.append((7000 + i, " ".join(w)))
    classes = {}
    for i, t in rows:
        if s := set_of(t, 4):
            classes.setdefault(s, []).append(i)
    linked = {s: sum(s != o and 100 * len(s & o) >= 85 * len(s | o) for o in classes) for s in classes}
    got = jaccard_join.near_duplicates(frame(spark, rows), 4, 85, 100, count_links=True).collect()
    assert sorted((r["id"], r["n_links"]) for r in got) == sorted((i, linked.get(set_of(t, 4), 0)) for i, t in rows)
    assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, 4, 85, 100)
    assert max(linked.values()) > 20


def test_jaccard_texts_of_one_id(spark):
    random.seed(8)
    a, b, c = ([f"{x}{random.randrange(10**6)}" for _ in range(60)] for x in "abc")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (9, near(a)), (11, near(b)), (3, near(c)), (20, " ".join(c)), (20, " ".join(a)), (20, " ".join(a)), (30, "alone in here")]
    got = jaccard_join.near_duplicates(frame(spark, rows), 4, 85, 100, count_links=True).collect()
    assert {(r["id"], r["component_id"]) for r in got} == {(i, 3) for i in (3, 5, 9, 11, 20)} | {(30, 30)}
    apart = jaccard_join.near_duplicates(frame(spark, rows[:4] + rows[8:]), 4, 85, 100, count_links=True).collect()
    assert sorted((r["id"], r["component_id"], r["n_links"]) for r in apart) == [(5, 5, 1), (5, 5, 1), (9, 5, 1), (11, 5, 1), (30, 30, 0)]
    assert sorted((r["id"], r["class_id"], r["n_links"]) for r in got) == [(3, 3, 1), (5, 5, 1), (5, 5, 1), (9, 9, 1), (11, 11, 1), (20, 5, 1), (20, 5, 1), (20, 20, 1), (30, 30, 0)]


def test_jaccard_odd(odd, empty):
    got = sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(odd, 4, 85, 100).collect()), key=str)
    assert len(got) == 11 and (None, 3, None) in got
    assert {(i, c) for i, _, c in got if i in (1, 2, 7, 8, 4)} == {(1, 1), (2, 1), (7, 7), (8, 7), (4, 4)}
    assert jaccard_join.near_duplicates(empty).count() == 0


# ---- classifiers


def test_codewords():
    for k in (2, 4, 7, 12):
        code = language_id.codewords(k)
        apart = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert min(apart) >= 1 and not (np.abs(code.sum(axis=0)) == k).any()


def test_language(spark, odd, empty):
    random.seed(4)
    make = {"en": "the and ing tion of with", "de": "der die und ung schön mit", "fr": "le la été que pour où"}
    rows = [(i, " ".join(random.choice(make[lang].split()) for _ in range(random.randrange(4, 40))), lang) for i in range(600) for lang in [random.choice(list(make))]]
    docs = spark.createDataFrame(rows + [(9000, None, "en"), (9001, "12 34 !", "en"), (9002, "the of", None)], "doc_id long, text string, lang string")
    model = language_id.train_language_model(docs, most=100)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model, carry=["doc_id"]).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) / len(held) > 0.97
    assert got[9000]["lang_pred"] == got[9001]["lang_pred"] == "und" and got[9000]["lang_score"] == 0 and got[9002]["lang_pred"] == "en"
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    one = language_id.train_language_model(odd)
    assert {r["lang_pred"] for r in language_id.identify(odd, one).collect()} == {"en", "und"}
    none = language_id.train_language_model(empty)
    assert {r["lang_pred"] for r in language_id.identify(odd, none, carry=odd.columns).collect()} == {"und"}


def test_toxicity(spark, odd, empty):
    random.seed(6)
    words = ["stone", "river", "cloud", "table", "green", "light", "paper"]
    rows, marks = [], []
    for i in range(800):
        toxic = int(random.random() < 0.25)
        w = [random.choice(words) for _ in range(random.randrange(5, 60))]
        if toxic:
            w.insert(random.randrange(len(w)), random.choice(["blorft", "krumpex"]))
        rows.append((i, " ".join(w)))
        if i % 4:
            marks.append((i, toxic))
    docs, labels = frame(spark, rows), spark.createDataFrame([*marks, (5, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, labels, bits=16)
    got = {r["id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    truth = {i: int("blorft" in t or "krumpex" in t) for i, t in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.score_toxicity(odd, model).count() == 11 and toxicity.score_toxicity(empty, model).count() == 0
    none = toxicity.train_toxicity(empty, labels)
    assert {r["predicted"] for r in toxicity.score_toxicity(odd, none).collect()} <= {0, 1}
    alone = toxicity.train_toxicity(docs, labels.filter("toxic = 0"))
    assert {r["predicted"] for r in toxicity.score_toxicity(odd, alone).collect()} == {0}
    assert toxicity.train_toxicity(docs, labels.limit(0)).score(["x"])[0] < 0.01


def test_telling_counts():
    g = toxicity.telling(np.array([10.0, 0, 5]), np.array([0.0, 10, 5]), 50, 50)
    assert g[0] > 10 and g[1] > 10 and g[2] == pytest.approx(0)


def test_held_out(spark):
    from paperlode.llm.common import held_out_column

    got = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", held_out_column().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert spark.createDataFrame([(None,)], DOCS.split(",")[0]).select(F.coalesce(held_out_column(), F.lit(None))).first()[0] is False

"""The stages of the pipeline against brute force, one after the other, on a small table."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from paperlode.llm import bpe, language_id, mixing

from test_classifiers import predict
from test_operators import brute_components, near_rows


def brute_mix(rows):
    """Copies of each id by the Poisson distribution function, one term at a time."""
    sources = Counter(r["source"] for r in rows)
    weights = {s: math.sqrt(n) for s, n in sources.items()}
    out = Counter()
    for r in rows:
        rate = len(rows) * weights[r["source"]] / sum(weights.values()) / sources[r["source"]]
        u = int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k, p = k + 1, p * rate / (k + 1)
            c += p
        out[r["doc_id"]] += k
    return sorted(out.elements())


def test_stages(spark, tmp_path):
    random.seed(9)
    rows = near_rows(120)
    random.seed(10)
    rows += [(6000 + i, t + " " * (i % 3)) for i, (_, t) in enumerate(rows[:30])]
    rows = [(i, t, "en", "hot" if i % 3 else "rest", len(t or "")) for i, t in rows]
    rows += [(9001, "123 456", "en", None, 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    held, kept = {r[0]: r[1] for r in rows}, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "bpe":
            assert out.columns == [c.split()[0] for c in schema.split(", ")]
        ids = sorted(r["doc_id"] for r in out.select("doc_id").collect())
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        if name == "language_id":
            model = language_id.train_language_model(docs)
            found = {i: predict(model, t) for i, t in before.items()}
            assert ids == sorted(i for i, (lang, _, ambiguous) in found.items() if lang != "und" and not ambiguous)
            assert ids == sorted(i for i, t in before.items() if re.search(r"[^\W\d_]", t or ""))
        if name == "exact_dedup":
            groups = {}
            for i, t in before.items():
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
            assert ids == sorted(min(g)[1] for g in groups.values())
        if name == "jaccard_join":
            assert ids == sorted({c for _, _, c in brute_components(list(before.items()), 5, 80, 100)})
        if name == "mix_sources":
            assert ids == brute_mix(docs.collect()) and set(ids) <= set(before)
        if name == "bpe":
            coder = bpe.Encoder(bpe.load_vocabulary(bpe.default_vocabulary()))
            assert ids == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
            assert all(bytes(r["ids"]) == coder.encode(held[r["doc_id"]] or "").astype("<u4").tobytes() for r in out.collect())
        docs = out
        kept.append(len(ids))
    assert kept[0] < len(rows) and kept[1] < kept[0] and kept[2] < kept[1]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[-1]


def test_language_stage_keeps_clean(spark):
    rows = [(i, "the river and the stone" if i % 2 else "der Fluss und der Stein", "en" if i % 2 else "de", "s", 20) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.language(spark, docs, "").count() == 80
    assert language_id.CodeModel([], language_id.codewords(0), None, None, None).predict(["a"]) == [("und", 0.0, False)]


def test_dedup_by_row(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema).repartition(3)
    texts = lambda out: sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    rows = [(3, b), (5, a), (5, b), (None, b), (7, c), (7, c + " "), (7, c), (None, d), (None, d), (8, "alone")]
    out = corpus_pipeline.exact(spark, frame(rows), "")
    assert out.columns == [x.split()[0] for x in schema.split(", ")]
    assert texts(out) == sorted([(3, b), (5, a), (7, c + " "), (None, d), (8, "alone")], key=str)
    rows = [(3, b), (5, a), (5, b + " end"), (None, b + " fin"), (7, c), (7, c + " end"), (None, d), (None, d + " end"), (8, "alone")]
    out = corpus_pipeline.near(spark, frame(rows), "")
    assert out.columns == [x.split()[0] for x in schema.split(", ")]
    assert texts(out) == sorted([(3, b), (5, a), (7, c + " end"), (None, d + " end"), (8, "alone")], key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, copy_no int, lang_pred string, id int, rate double"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, name):
    """Nulls in every column, repeated and null ids, empty and long texts, ties, clashing names, an empty table."""
    stage, wide = dict(corpus_pipeline.STAGES)[name], [c.split()[0] for c in SCHEMA.split(", ")]
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = [(1, "a b c d e f"), (2, "a  b c\td e f"), (3, None), (4, ""), (5, " \n"), (6, "12 34"), (7, long), (8, long), (2, "quite another text of this id"), (None, "no id here at all"), (None, "no id here at all"), (11, "é漢🙂 \x85x")]
    rows = [(i, t, [None, "en"][k % 2], [None, "s", "t"][k % 3], None, "key", 7, "xx", 3, 0.5) for k, (i, t) in enumerate(texts)]
    out = stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(2), "")
    held = out.collect()
    assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
    if name == "bpe":
        assert len(held) == len(rows) and {r["n_tokens"] for r in held if r["doc_id"] in (3, 4)} == {0}
        return
    assert out.columns == wide and all(tuple(r)[5:] == ("key", 7, "xx", 3, 0.5) for r in held)
    got = Counter((r["doc_id"], r["text"]) for r in held)
    every = Counter(texts)
    if name == "language_id":
        assert got == Counter({k: n for k, n in every.items() if re.search(r"[^\W\d_]", k[1] or "")})
    if name == "exact_dedup":
        assert got == Counter([(2, "a  b c\td e f"), (5, " \n"), (6, "12 34"), (7, long), (2, "quite another text of this id"), (None, "no id here at all"), (11, "é漢🙂 \x85x")])
    if name == "jaccard_join":
        gone = Counter([(2, "a  b c\td e f"), (8, long), (None, "no id here at all")])
        assert got == every - gone
    if name == "mix_sources":
        assert set(got) <= set(every) and sum(got.values()) > 3


def test_language_without_labels(spark):
    rows = [(i, "some words" if i % 2 else "12", None, "s", 5) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()) == [1, 3, 5, 7, 9]

"""Operators that SQL can't state, against brute force, fakes of libraries that are absent, and round trips."""

import json
import random
import sys
import types

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlode.api import Index
from paperlode.config import FieldMap, Settings
from paperlode.functions.stemming import stem
from paperlode.operators import chunks, entities, linkage, memory, profile, reading, snippets, textindex, topics, vectors
from paperlode.plans import sql_gate
from paperlode.sources import adapters, files, records, transcripts
from paperlode.stores import MOST_VERSIONS, ParquetStore, open_store
from paperlode.streaming import ingest

DOCS = "/root/testdata/sf0.001"


def texts(spark, n=200):
    random.seed(1)
    words = ["rail", "rails", "railing", "safety", "bridge", "bridges", "tax", "taxes", "well-known", "café", "the", "of"]
    return spark.createDataFrame([(f"c{i:03}", " ".join(random.choice(words) for _ in range(random.randrange(0, 30)))) for i in range(n)], "chunk_id string, text string")


# ---- keyword index


@pytest.mark.parametrize("stemmed", [False, True])
def test_index_gives_what_a_scan_gives(spark, tmp_path, monkeypatch, stemmed):
    monkeypatch.setattr(textindex, "CHUNKS_A_FOLDER", 30)
    rows = texts(spark)
    textindex.write_index(rows, f"file://{tmp_path}/index", stemmed)
    for query in ("rail", "rails taxes", "well-known cafe", "nosuch", "", "bridges' rail"):
        want = [(r[0], pytest.approx(r[1])) for r in textindex.bm25(rows, query, 15, stem=stemmed).collect()]
        got = [tuple(r) for r in textindex.indexed_bm25(spark, f"file://{tmp_path}/index", query, 15, stemmed).collect()]
        assert got == want and (len(got) > 3) == (query not in ("nosuch", "")), query
    some = rows.filter("chunk_id < 'c050'")
    among = textindex.indexed_bm25(spark, f"file://{tmp_path}/index", "rail", 500, stemmed, among=some).collect()
    every = {r[0]: r[1] for r in textindex.indexed_bm25(spark, f"file://{tmp_path}/index", "rail", None, stemmed).collect()}
    assert {r[0]: r[1] for r in among} == {k: v for k, v in every.items() if k < "c050"}
    plan = textindex.indexed_bm25(spark, f"file://{tmp_path}/index", "rail", 5, stemmed)._jdf.queryExecution().toString()
    assert "PartitionFilters: [folder" in plan and "PushedFilters: [In(term" in plan or "EqualTo(term" in plan


def test_stemmed_search_counts_stems(spark):
    rows = spark.createDataFrame([("a", "railing on rails"), ("b", "a rail"), ("c", "trails")], "chunk_id string, text string")
    assert [r[0] for r in textindex.bm25(rows, "rail", 5, stem=True).collect()] == ["a", "b"]
    held = {r["chunk_id"]: (r["tf"], r["positions"], r["dl"]) for r in textindex.postings(rows, stem=True).filter("term = 'rail'").collect()}
    assert held == {"a": (2, [0, 2], 3), "b": (1, [1], 2)}


# ---- snippets, chunks


MINUTES = ("•Item 5: The members approve an amendment to the\r\nGuidelines to include more of these. \r\n"
           "Dr. Smith confirmed that the figures were accepted by members.\nNext words of the same sentence go on. J. Doe said so!\n•Another point of some length stands here")  # fmt: skip


def test_sentences():
    shown = [" ".join(MINUTES[s:e].split()) for s, e in snippets.sentences(MINUTES)]
    assert shown == ["Item 5: The members approve an amendment to the Guidelines to include more of these.", "Dr. Smith confirmed that the figures were accepted by members.", "Next words of the same sentence go on.", "Another point of some length stands here"]
    assert snippets.sentences("") == [] and snippets.sentences("too short. this too.") == []


def test_windows():
    filler, target = "The board discussed matters of procedure and the rules at length. ", "The northern exchange was suspended by a resolution of members. "
    text, weights = filler * 8 + target + filler * 8, {"suspended": 4.0, "members": 2.0, "board": 0.1}
    got = snippets.best_window(text, weights)
    assert "northern exchange was suspended" in got and got.startswith("…") and got.endswith("…") and len(got) <= 262
    assert snippets.best_window(text, {}) == snippets.best_window(text, {"absent": 3.0}) == " ".join(text[:260].split()) + "…"
    long = "word " * 100 + "suspended " + "word " * 100 + ". " + filler
    assert "suspended" in snippets.best_window(long, weights)
    assert snippets.salience("board Members suspended members", weights) == pytest.approx((4 + 2 + 0.1) / 3)


def test_semantic_weights(spark):
    rows = spark.createDataFrame([(str(i), "the board of the members voted") for i in range(20)] + [("x", "nairobi suspension")], "chunk_id string, text string")
    meaning = {"suspension": [1.0, 0.0], "removed": [1.0, 0.1], "nairobi": [0.2, 1.0], "board": [0.3, -1.0], "the": [-1.0, 0.0]}
    embed = lambda words: np.array([meaning.get(w, [0.0, 0.01]) for w in words])
    weights = snippets.word_weights(rows, "removed", ["nairobi suspension the board"], embed)
    assert weights["suspension"] > weights["nairobi"] > weights.get("board", 0) and "the" not in weights
    hits = rows.filter("chunk_id = 'x'")
    assert "nairobi" in snippets.window_snippets(hits, rows, "removed", embed=embed).first()["snippet"]


def test_keyword_snippet():
    text = "one two three " * 10 + "the rails of safety are long " + "four five six " * 10
    assert "[rails] of [safety]" in snippets.keyword_snippet(text, {stem("rail"), stem("safety")})
    assert snippets.keyword_snippet("", {"a"}) == "" and snippets.keyword_snippet("a b", {"b"}) == "a [b]"


def brute_chunks(text, size, overlap):
    """The rule of chunking, told place by place."""
    import re

    cuts = [0] + [m.end() for m in re.finditer(r"(?<=[.!?])\s+|\n\n+", text)]
    near = lambda t: sorted(cuts, key=lambda c: (abs(c - t), c))[0]
    out, start = [], 0
    while text.strip() and start < len(text):
        end = min(start + size, len(text))
        if end < len(text) and near(end) > start:
            end = near(end)
        body = text[start:end]
        if body.strip():
            s = start + len(body) - len(body.lstrip())
            out.append((s, s + len(body.strip())))
        if end >= len(text):
            break
        back = end - overlap if end - overlap > start else end
        start = near(back) if not out or near(back) > out[-1][0] else back
    return out


def test_chunks_place_by_place():
    random.seed(2)
    sizes = chunks.ChunkSizes(20, 5)
    for _ in range(300):
        text = "".join(random.choice(["word ", "a. ", "b! ", "\n\n", " ", "long" * 9, "é", "?\n"]) for _ in range(random.randrange(0, 120)))
        assert list(chunks.chunk_spans(text, sizes)) == brute_chunks(text, sizes.chars, sizes.overlap)


# ---- entities


def test_trees_find_the_same_whatever_their_number(spark, monkeypatch):
    random.seed(3)
    words = ["acme", "group", "the", "of", "zeta", "&", "l'", "pizza", "ß"]
    names = sorted({" ".join(random.choice(words) for _ in range(random.randrange(1, 4))) for _ in range(60)} | {"&pizza"})
    known = spark.createDataFrame([(n, "org", n.title() if i % 3 else n) for i, n in enumerate(names)], "name string, type string, spelled string")
    docs = spark.createDataFrame([(str(i), " ".join(random.choice([w, w.upper(), w + ",", "x" + w]) for w in random.choices(words, k=30)) + " H.R. 12") for i in range(40)] + [("none", None)], "doc_id string, text string")
    one = sorted(map(tuple, entities.find_mentions(docs, known).collect()))
    monkeypatch.setattr(entities, "MOST_NAMES", 7)
    several = sorted(map(tuple, entities.find_mentions(docs, known).collect()))
    assert one == several and len(one) > 200 and sum(r[2] == "bill" for r in one) == 40
    assert entities.find_mentions(docs, known.limit(0)).count() == 40


# ---- linkage, vectors


def test_jaro_winkler_against_duckdb(spark):
    random.seed(4)
    pairs = [tuple("".join(random.choice("abcdé ") for _ in range(random.randrange(0, 14))) for _ in range(2)) for _ in range(800)] + [("martha", "marhta"), ("a" * 90, "a" * 88 + "bc"), ("", ""), ("", "a")]
    got = linkage.jaro_winkler_pairs(*(list(x) for x in zip(*pairs, strict=True)))
    con = duckdb.connect()
    ascii_pairs = [(i, a, b) for i, (a, b) in enumerate(pairs) if (a + b).isascii() and a and b]
    for i, a, b in ascii_pairs:
        assert got[i] == pytest.approx(con.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]), (a, b)
    rows = spark.createDataFrame([*pairs, (None, "x")], "a string, b string")
    column = [r[0] for r in rows.select(linkage.jaro_winkler_column(F.col("a"), F.col("b"))).collect()]
    assert column[:-1] == pytest.approx(got.tolist()) and column[-1] is None


def test_hashing_embedder_word_by_word():
    import zlib

    def plain(text, dim=256):
        out = np.zeros(dim)
        for word in text.lower().split():
            for piece in (word, *(f"#{word}#"[j : j + 3] for j in range(len(word)))):
                h = zlib.crc32(piece.encode())
                out[h % dim] += 1 if h >> 16 & 1 else -1
        return out / (np.linalg.norm(out) or 1)

    batch = ["The rail safety", "", "é à é é", "a " * 50, None]
    assert np.allclose(vectors.embedder()(batch), [plain(t or "") for t in batch], atol=1e-6)
    assert vectors.embedder()([]).shape == (0, 256)


def test_quantised_recall(spark):
    rng = np.random.default_rng(5)
    held = rng.normal(size=(2000, 63)).astype(np.float32)
    held /= np.linalg.norm(held, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(held)], "vec_id int, embedding array<float>").cache()
    index = vectors.quantised(rows, "vec_id").cache()
    assert index.select(F.max(F.length("codes"))).first()[0] == 32 and index.count() == 2000
    found = total = 0
    for i in range(0, 2000, 20):  # ids divisible by 20, against all rows
        q = spark.createDataFrame([(held[i].tolist(),)], "q array<float>")
        if i % 200 == 0:
            got = {r["id"] for r in vectors.quantised_nearest(index, rows, q, 10, more=10, id_col="vec_id").collect()}
        else:  # the same codes, scored in numpy, to keep the test short
            codes = np.rint(held / np.abs(held).max(axis=1, keepdims=True) * 7)
            rough = (codes @ held[i]) * np.abs(held).max(axis=1)
            pool = np.argsort(-rough)[:100]
            got = set(pool[np.argsort(-(held[pool] @ held[i]))[:10]].tolist())
        found, total = found + len(got & set(np.argsort(-(held @ held[i]))[:10].tolist())), total + 10
    assert found / total >= 0.9


def test_vectors_by_id_and_centroid_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i == j) for j in range(8)]) for i in range(8)], "chunk_id int, embedding array<float>")
    assert sorted(r["chunk_id"] for r in vectors.vectors_of(rows, [3, 5, 3, 99]).collect()) == [3, 5]
    c = rows.select(F.col("chunk_id").alias("cluster"), F.col("embedding").alias("c"))
    whole = sorted(map(tuple, vectors.nearest_centroid(rows, c).collect()))
    monkeypatch.setattr(vectors, "CENTROIDS", 3)
    assert sorted(map(tuple, vectors.nearest_centroid(rows, c).collect())) == whole == [(i, i, 1.0) for i in range(8)]


def test_rerank_breaks_ties_by_id(spark):
    hits = spark.createDataFrame([("b", "rail"), ("a", "rail"), ("c", "rail tax"), ("d", None)], "chunk_id string, text string")
    assert [r["chunk_id"] for r in vectors.rerank(hits, "rail tax", "overlap", 3).collect()] == ["c", "a", "b"]
    with pytest.raises(KeyError):
        vectors.rerank(hits, "x", "nosuch", 1)


# ---- adapters, with fakes of the libraries


def fake(monkeypatch, name, **members):
    module = types.ModuleType(name)
    vars(module).update(members)
    monkeypatch.setitem(sys.modules, name, module)


def test_embedder_adapters(monkeypatch):
    class Encodes:
        def __init__(self, model="m"):
            self.model = model

        @classmethod
        def from_pretrained(cls, model):
            return cls(model)

        def encode(self, texts, **_):
            return [[3.0, 4.0] if t else [0.0, 0.0] for t in texts]

    for name in ("static", "sbert", "openai", "voyage"):
        with pytest.raises(vectors.NotInstalled):
            vectors.embedder(name)
    fake(monkeypatch, "model2vec", StaticModel=Encodes)
    fake(monkeypatch, "sentence_transformers", SentenceTransformer=Encodes)
    for name in ("static", "sbert"):
        assert np.allclose(vectors.embedder(name)(["a", None]), [[0.6, 0.8], [0, 0]])
    asked = []

    class Client:
        def __init__(self, api_key=None, base_url=None):
            self.embeddings, self.url = self, base_url

        def create(self, model, input):  # noqa: A002
            asked.append((self.url, model, len(input)))
            return types.SimpleNamespace(data=[types.SimpleNamespace(index=i, embedding=[float(len(t)), 0.0]) for i, t in reversed(list(enumerate(input)))])

        def embed(self, input, model):  # noqa: A002
            return types.SimpleNamespace(embeddings=[[0.0, 2.0] for _ in input])

    fake(monkeypatch, "openai", OpenAI=Client)
    fake(monkeypatch, "voyageai", Client=Client)
    for name in ("openai", "deepinfra", "gemini", "api"):
        assert np.allclose(vectors.embedder(name)(["abc"] * 100), [[1, 0]] * 100)
    assert len(asked) == 8 and {u for u, *_ in asked} >= {None, vectors.SERVICES["deepinfra"][1]} and vectors.embedder("voyage")(["x"]).tolist() == [[0, 1]]


def test_cross_encoder(monkeypatch):
    with pytest.raises(vectors.NotInstalled):
        vectors.RERANKERS["cross-encoder"]()
    fake(monkeypatch, "sentence_transformers", CrossEncoder=lambda model: types.SimpleNamespace(predict=lambda pairs: [len(p) for _, p in pairs]))
    assert vectors.RERANKERS["cross-encoder"]()("q", ["a", "abc"]) == [1.0, 3.0]


class FakePdf(list):
    """Two pages: one of text, one blank."""

    def __init__(self, content):
        page = lambda t: types.SimpleNamespace(get_textpage=lambda: types.SimpleNamespace(get_text_range=lambda: t), render=lambda scale: types.SimpleNamespace(to_pil=lambda: types.SimpleNamespace(convert=lambda m: types.SimpleNamespace(save=lambda f, k: f.write(b"png" + t.encode())))))
        super().__init__([page(content.decode()), page("")])


def test_pdf_adapter_and_images(monkeypatch, tmp_path):
    fake(monkeypatch, "pypdfium2", PdfDocument=FakePdf)
    text, pages, _ = adapters.parse("pdf", "pdfium", b"a page of text that is long enough")
    assert [(p["number"], p["page_class"]) for p in pages] == [(1, "text"), (2, "empty")] and text.startswith("a page")
    source = tmp_path / "scan.pdf"
    source.write_bytes(b"words on a page that was scanned")
    assert len(transcripts.write_images(str(source), str(tmp_path / "images"))) == 2
    state = transcripts.state(str(source), str(tmp_path / "images"))
    assert state == {"path": str(source), "transcribed": False, "stale": None, "waiting": [1, 2]}
    monkeypatch.setattr(adapters, "ocr_page", lambda image, lang, mode: ("read by a machine, long enough", 30.0 if image.endswith(b"png") else 90.0))
    transcripts.ocr_file(str(source), pages="1")
    assert transcripts.remaining_pages(str(source), 2) == [2] and not transcripts.is_stale(str(source))
    with pytest.raises(ValueError):
        transcripts.import_vision(str(source), {3: "x"}, transcripts.images_of(str(source), str(tmp_path / "images")), "m")
    transcripts.import_vision(str(source), {2: "seen by a model"}, transcripts.images_of(str(source), str(tmp_path / "images")), "m")
    data = json.loads(transcripts.transcript_path(str(source)).read_text())
    assert data["text_provenance"] == "vision" and [p["tier"] for p in data["pages"]] == ["ocr", "vision"]
    source.write_bytes(b"other")
    assert transcripts.is_stale(str(source)) and transcripts.page_numbers("1-3,7,90", 8) == [1, 2, 3, 7]


# ---- index: transcripts, verification, store, memory, fields


def test_transcripts_in_build_and_verification(spark, tmp_path):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    source = corpus / "scan.md"
    source.write_text("garbled scan of a page")
    (corpus / "plain.txt").write_text("Plain words about bridges stand here.")
    transcripts.write_transcript(str(source), [{"page_no": 1, "text": "The bridge was closed by the board."}, {"page_no": 2, "text": "Second page of words."}], "ocr", "engine")
    index = Index(spark, str(tmp_path / "index"))
    index.build([str(corpus)])
    docs = {r["title"]: r for r in index.table("documents").collect()}
    assert docs["scan"]["text_provenance"] == "ocr" and docs["scan"]["text"].startswith("The bridge")
    token = index.search("board", mode="keyword").first()["token"]
    got = index.verify(token, "closed by the board").first()
    assert got["verified"] and got["source_confirmed"] and got["caveat"] == "machine_misread_possible"
    assert index.search("bridge", mode="keyword").first()["snippet"].count("[") >= 1
    transcripts.write_transcript(str(source), [{"page_no": 1, "text": "Another reading altogether."}], "ocr", "engine")
    assert index.verify(token, "closed by the board").first()["source_confirmed"] is False
    assert {r["match_mode"] for r in index.search("", k=1).collect()} == {"all"}
    assert index.has("keyword") and index.reset() is None and not index.has("keyword") and index.has("trace")


def test_parsers_are_pinned(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(adapters.PARSERS, ("pdf", "one"), lambda content: ("read by one", None, None))
    one = files.documents_of(b"x", "pdf", "f1", "a.pdf", Settings(parsers={"pdf": "one"}))[0]
    assert one["parser"] == "one" and one["text"] == "read by one"
    again = files.documents_of(b"x", "pdf", "f1", "a.pdf", Settings(parsers={"pdf": "other"}), parser=one["parser"])[0]
    assert again["text"] == "read by one" and again["error"] is None


def test_fields_by_source_and_recall(spark, tmp_path):
    corpus = tmp_path / "corpus"
    (corpus / "press").mkdir(parents=True)
    (corpus / "press" / "a.jsonl").write_text('{"url": "u", "title": "T", "n": 5}\n{"url": "v", "title": "W"}')
    (corpus / "b.json").write_text('[{"firm": "Acme", "items": [1]}]')
    settings = Settings(default=FieldMap(structured_fields=("firm",)), sources=(FieldMap(match="press/*.jsonl", text_fields=("title",), structured_fields=("n",)),))
    index = Index(spark, str(tmp_path / "index"), settings)
    index.build([str(corpus)])
    got = {(r["source"], r["name"]): (r["aggregatable"], r["searchable"], list(r["types"]), r["example"]) for r in index.fields().collect()}
    assert got["press/*.jsonl", "title"] == (False, True, ["str"], "T") and got["press/*.jsonl", "n"] == (True, False, ["int"], "5")
    assert got["press/*.jsonl", "url"][1] is False and got["default", "firm"] == (True, True, ["str"], "Acme") and got["default", "items"][2] == ["list"]
    (tmp_path / "x.csv").write_text("firm,paid\nAcme,7\n")
    assert index.sql("SELECT sum(paid) AS s FROM outside", files={"outside": str(tmp_path / "x.csv")}).first()["s"] == 7
    first = index.note("bridges are old", kind="lead", entity_ids=["e_1"])
    index.note("taxes on bridges", kind="note")
    index.update_note(first, status="closed")
    assert {r["id"] for r in index.recall("bridges").collect()} == {str(r["id"]) for r in index.notes().collect()}
    assert [r["id"] for r in index.recall("bridges", kind="lead", status="closed").collect()] == [str(first)]
    assert index.recall("bridges", entity="e_1").count() == 1 and index.recall("bridges", mode="semantic").count() == 2
    assert json.loads(json.dumps(index.status(), default=str))["counts"]["documents"] == 3
    assert "config.toml" in index.init() and Settings.load(open(index.init()).read()) == Settings()


def test_store(spark, tmp_path):
    store = open_store("parquet", spark, f"file://{tmp_path}/s")
    assert isinstance(store, ParquetStore) and store.versions("log") == []
    for i in range(MOST_VERSIONS + 1):
        store.append("log", spark.createDataFrame([(i,)], "i int"))
    assert len(store.versions("log")) == 1 and sorted(r[0] for r in store.log("log").collect()) == list(range(MOST_VERSIONS + 1))
    with pytest.raises(KeyError):
        open_store("nosuch", spark, "x")


def test_whole_digest_decides(spark):
    rows = [("a", "txt", 1, "aa" * 32, "f1"), ("b", "txt", 1, "aa" * 31 + "bb", "f1"), ("c", "bin", 1, "cc" * 32, "f2"), ("d", "txt", 1, "aa" * 32, "f1")]
    found = spark.createDataFrame(rows, "path string, kind string, length long, sha256 string, file_id string").withColumn("kind", F.when(F.col("kind") == "bin", "unsupported").otherwise(F.col("kind")))
    first = files.ingest(found, None)
    assert {r["path"]: r["change"] for r in first.collect()} == {"a": "added", "b": "added", "c": "unsupported", "d": "skipped"}
    later = files.ingest(found.withColumn("sha256", F.when(F.col("path") == "a", "dd" * 32).otherwise(F.col("sha256"))), first.filter("change = 'added'"))
    assert {r["path"]: r["change"] for r in later.collect()} == {"a": "updated", "b": "skipped", "c": "unsupported", "d": "skipped"}


def test_array_paths():
    rec = {"a": [{"b": [1, 2, None, True], "c": "x"}, {"b": 3}], "d/e": {"#": ["q", "q"]}, "f": [[1], [2]]}
    assert records.array_values(rec, "a[].b[]") == [1, 2, 3] and records.array_values(rec, "a[].c") == ["x"] and records.array_values(rec, "a.b[]") == []
    assert records.array_values(rec, "d/e.#[]") == ["q"] and records.array_values(rec, "f[]") == [] and records.array_values("x", "a[]") == []


# ---- profile, topics, memory, streaming, gate


def test_suggested_map(spark):
    rows = [("id", ["str"], "x1"), ("filing_uuid", ["str"], "u"), ("registrant", ["str"], "Acme"), ("client.name", ["str"], "Zeta"), ("member.party", ["str"], "Q"), ("lobbyists", ["list"], None), ("text", ["str"], "x" * 80), ("amount", ["int"], "5"), ("staff.name", ["str"], "Ann"), ("meta", ["object"], None)]
    got = profile.suggest_map(spark.createDataFrame(rows, "name string, types array<string>, example string"))
    assert got == {"record_id": "id", "text_fields": ["text"], "structured_fields": ["amount", "client.name", "filing_uuid", "id", "member.party", "registrant", "staff.name"], "entity_fields": ["client.name:org", "lobbyists:person", "registrant:org", "staff.name:person"]}


def test_peek_folder(spark):
    rows = [(f"/c/2024/{i}/f{i}.json", '{"a": 1, "b": 2}') for i in range(3)] + [("/c/x.json", '{"z": 1}')]
    got = [tuple(r) for r in profile.peek_folder(spark.createDataFrame(rows, "path string, raw string")).collect()]
    assert got == [("a,b", 3, "/c/*/*/*.json"), ("z", 1, "/c/*.json")]


def test_samples_and_topics(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(50)], "doc_id int, text string")
    assert reading.sample_ids(docs, 3, "first") == ["0", "1", "10"] and len(reading.sample_ids(docs, 7, seed=1)) == 7
    assert 10 <= reading.spread_sample(docs, 25).count() <= 40 and topics.auto_k(200) == 10


def test_latest(spark):
    log = spark.createDataFrame([(1, "a", 5), (1, "b", 7), (2, "c", None)], "id int, text string, at int")
    assert sorted(map(tuple, memory.latest(log, ["id"], ["at"]).collect())) == [(1, "b", 7), (2, "c", None)]


def test_streaming(spark, tmp_path):
    corpus = tmp_path / "in"
    corpus.mkdir()
    (corpus / "a.json").write_text('[{"firm": "Acme", "n": 1}]')
    ingest.run_available(spark, f"file://{corpus}", f"file://{tmp_path}/out")
    (corpus / "b.txt").write_text("Later words that are long enough.")
    (corpus / "c.pdf").write_text("no library here")
    ingest.run_available(spark, f"file://{corpus}", f"file://{tmp_path}/out")
    ingest.run_available(spark, f"file://{corpus}", f"file://{tmp_path}/out")
    docs = spark.read.parquet(f"file://{tmp_path}/out/documents").collect()
    assert sorted(r["source_path"].rsplit("/")[-1] for r in docs) == ["a.json", "b.txt", "c.pdf"] and sum(r["error"] is not None for r in docs) == 1
    assert spark.read.parquet(f"file://{tmp_path}/out/chunks").count() == 2


def test_windowed_counts(spark, tmp_path):
    rows = spark.read.parquet(f"{DOCS}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    rows.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/events")
    query = ingest.windowed_counts(stream, "1 day").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").count().count()
    got = spark.table("windows")
    assert got.count() == want and got.agg(F.sum("n")).first()[0] == rows.count()


@pytest.mark.parametrize("bad", ["SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT reflect('java.lang.System', 'exit', 1) FROM region", "SELECT 1 WHERE EXISTS (SELECT try_reflect('a', 'b'))",
                                 "SELECT (SELECT max(java_method('a', 'b')) FROM region)", "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`", "SELECT * FROM csv.`/tmp/in/../x.csv`", "WITH a AS (SELECT raise_error('x')) SELECT * FROM a",
                                 "SELECT * FROM region ORDER BY input_file_name()", "SELECT * FROM region WHERE r_regionkey IN (SELECT reflect('a', 'b'))", "SELECT * FROM region LATERAL VIEW explode(array(reflect('a', 'b'))) x", "SELECT current_user()", "DELETE FROM region"])
def test_gate_is_shut(spark, bad):
    spark.read.parquet(f"{DOCS}/region.parquet").createOrReplaceTempView("region")
    with pytest.raises(sql_gate.NotReadOnly):
        sql_gate.run_sql(spark, bad, folders=("/tmp/in",))


def test_gate_lets_queries_through(spark, tmp_path):
    spark.read.parquet(f"{DOCS}/region.parquet").createOrReplaceTempView("region")
    good = ["SELECT round(sum(r_regionkey), 2), count(*), upper('x'), coalesce(NULL, 1), CASE WHEN max(r_regionkey) > 1 THEN 'a' END FROM region", "SELECT rank() OVER (ORDER BY r_regionkey), median(r_regionkey) OVER () FROM region",
            "SELECT explode(array(1, 2))", "SELECT * FROM range(3)", "SELECT regexp_replace('a', 'b', 'c'), try_cast('1' AS int), date_trunc('month', current_date()), 1 % 2, get_json_object('{}', '$.a')"]
    for statement in good:
        sql_gate.run_sql(spark, statement).collect()
    assert sql_gate.run_sql(spark, f"SELECT * FROM parquet.`{DOCS}/region.parquet`", folders=(DOCS,)).count() == 5
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    sql_gate.external_table(spark, "lines", f"{tmp_path}/x.jsonl")
    assert sql_gate.run_sql(spark, "SELECT sum(a) AS s FROM lines").first()["s"] == 3
    with pytest.raises(ValueError):
        sql_gate.external_table(spark, "lines", "x.exe")


@pytest.mark.parametrize("k", [3, "3"])
def test_kmeans_against_nearest_mean(spark, k):
    """Well parted heaps of points are the clusters, and every point lies nearest to its own cluster's mean."""
    rng = np.random.default_rng(5)
    heaps = np.array([[0.0, 0.0], [20.0, 0.0], [0.0, 20.0]])
    points = [(i, (heaps[i % 3] + rng.normal(size=2)).tolist()) for i in range(90)]
    rows = spark.createDataFrame(points, "chunk_id bigint, embedding array<float>")
    found = {r["id"]: r["cluster"] for r in topics.cluster_vectors(rows, k).collect()}
    assert sorted(found) == list(range(90))
    assert len({(i % 3, c) for i, c in found.items()}) == 3
    means = {c: np.mean([v for i, v in points if found[i] == c], axis=0) for c in set(found.values())}
    assert all(min(means, key=lambda c: np.linalg.norm(means[c] - v)) == found[i] for i, v in points)
    none = topics.cluster_vectors(rows.limit(0), k)
    assert none.dtypes == [("id", "bigint"), ("cluster", "int")] and none.isEmpty()

import json
import random

import pytest
from pyspark.sql import functions as F

from paperlode.config import FieldMap, Settings
from paperlode.functions import columns as C
from paperlode.functions.stemming import stem
from paperlode.operators import aggregate as A
from paperlode.operators import anomalies, chunks, citations, entities, linkage, reading, textindex
from paperlode.plans.sql_gate import NotReadOnly, run_sql
from paperlode.sources import files, records


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr).first()[0]


def test_flexible_blanks():
    assert C.flexible_blanks("a b  c") == r"a\s+b\s+c"
    assert C.flexible_blanks(r"a\ b[ x] ?") == r"a\ b[ x]\s?"


def test_name_keys(spark):
    rows = spark.createDataFrame([("Acme Group, L.L.C.", "org"), ("The Co", "org"), ("H.R. 12", "bill"), ("Ann-Marie Poe", "person")], "n string, k string")
    got = [r[0] for r in rows.select(C.name_key("n", F.col("k"))).collect()]
    assert got == ["acme group", "the co", "hr12", "ann marie poe"]


def test_page_class(spark):
    rows = spark.createDataFrame([("   ",), ("x" * 30,), ("--- " * 20,), ("aa  bb  " * 10,)], "t string")
    assert [r[0] for r in rows.select(C.page_class("t")).collect()] == ["empty", "text", "bad_ocr", "table"]


def test_numbers(spark):
    rows = spark.createDataFrame([("12",), (" 1e3 ",), ("12d",), ("NaN",), (None,), ("-.5",)], "t string")
    assert [r[0] for r in rows.select(C.number("t")).collect()] == [12.0, 1000.0, None, None, None, -0.5]


def test_stems():
    assert [stem(w) for w in ("running", "caresses", "relational", "ponies", "hopeful", "sky")] == ["run", "caress", "relat", "poni", "hope", "sky"]


def test_records():
    data = {"meta": 1, "rows": [{"id": "x", "a": {"b": [1, 2, True]}, "c": None, "d": [{"e": "q"}, {"e": "q"}, {"e": "r"}]}]}
    got = records.file_records(json.dumps(data).encode(), "json", FieldMap())
    assert got[0][0] == "/rows/0"
    rec = got[0][1]
    assert records.render(rec, FieldMap()) == "id: x\na.b: 1; 2; true\nd[0].e: q\nd[1].e: q\nd[2].e: r"
    assert records.array_values(rec, "d[].e") == ["q", "r"]
    assert records.field_spec("d[].e as es") == ("d[].e", "es")
    assert records.at_pointer({"a/b": [1, {"~": 2}]}, "/a~1b/1/~0") == 2
    assert records.render(rec, FieldMap(text_fields=("id",), entity_fields=("a:org",))) == "id: x\na.b: 1; 2; true"
    assert [x for x, _ in records.file_records(b'{"a":1}\n\n{"a":2}\n', "jsonl", FieldMap())] == ["/0", "/1"]
    xml = records.file_records(b"<r xmlns='u'><f><n> A </n><t>1</t><t>2</t><z> </z></f><f/></r>", "xml", FieldMap(record_path="{u}f"))
    assert xml == [("0", {"n": "A", "t": ["1", "2"], "_root": "f"}), ("1", {"text": None, "_root": "f"})]


def test_map_choice():
    s = Settings(sources=(FieldMap(match="press/*.jsonl", record_id="u"),))
    assert s.map_for("/x/press/a/b.jsonl").record_id == "u" and s.map_for("/x/other.json").record_id is None
    assert s.map_hash() != Settings().map_hash()


def test_chunks():
    text = ("One sentence here. " * 200) + "tail"
    sizes = chunks.ChunkSizes(40, 8)
    spans = list(chunks.chunk_spans(text, sizes))
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a < c <= b for (a, b), (c, _) in zip(spans, spans[1:]))
    assert all(text[s:e] == text[s:e].strip() for s, e in spans)
    assert list(chunks.chunk_spans("  \n ")) == []


def test_aggregate_folds(spark):
    rows = spark.createDataFrame([("Acme LLC", "100000"), ("ACME, L.L.C.", "300000"), ("Boron", "x"), (None, "1")], "firm string, amount string")
    canon = spark.createDataFrame([("acme", "Acme LLC")], "norm_key string, canonical_name string")
    got = {r[0]: (r[1], r[2]) for r in A.aggregate(rows, "firm", "sum", "amount", canon=canon).collect()}
    assert got == {"Acme LLC": (400000.0, 2), "Boron": (0.0, 1)}
    with pytest.raises(ValueError):
        A.aggregate(rows, "firm", "avg", "amount", canon=canon)
    with pytest.raises(ValueError):
        A.aggregate(rows, "firm; drop", "count")


def test_peer_outlier(spark):
    rows = spark.createDataFrame([(str(i), "f", float(v)) for i, v in enumerate([98, 99, 100, 102, 104, 105, 5000])], "doc_id string, firm string, amount double")
    got = anomalies.peer_outliers(rows, "firm", "amount").collect()
    assert [(r["value"], r["direction"], r["group_n"]) for r in got] == [(5000.0, "high", 7)] and got[0]["ratio"] > 40
    few = rows.filter("doc_id in ('0','1','2','6')")
    assert anomalies.peer_outliers(few, "firm", "amount").count() == 0
    assert [r["value"] for r in anomalies.peer_outliers(few, "firm", "amount", min_peers=2).collect()] == [5000.0]


def test_rare_whale(spark):
    rows = [(f"{c}-{i}", f"c{c}", 100.0) for c in range(10) for i in range(3)] + [(f"b{i}", "big", 100000.0) for i in range(4)] + [("w", "whale", 500000.0)]
    got = anomalies.rare_groups(spark.createDataFrame(rows, "doc_id string, client string, amount double"), "client", "amount")
    assert [r["grp"] for r in got.collect()] == ["whale"]


def test_matcher():
    names = {"acme group": ("org", "Acme Group"), "clear": ("org", "Clear"), "&pizza": ("org", "&pizza"), "ab": ("org", "Ab")}
    text = "acme GROUP met Clear and clear at &pizza; Ab acmegroup."
    find = lambda **k: [text[s:e] for s, e, _ in entities.NameTree([(n, *v) for n, v in names.items()], **k).spans(text)]
    assert find() == ["acme GROUP", "Clear", "&pizza"]
    assert find(single_word="any-case") == ["acme GROUP", "Clear", "clear", "&pizza"]
    assert find(single_word="off") == ["acme GROUP"]
    assert "Ab" in find(min_len=2)


def test_entities_resolve(spark):
    docs = spark.createDataFrame([("d1", "Acme Group LLC and Zeta"), ("d2", "ACME GROUP LLC; H.R. 12"), ("d3", None)], "doc_id string, text string")
    names = spark.createDataFrame([("acme group llc", "org", "Acme Group LLC"), ("zeta", "org", "Zeta")], "name string, type string, spelled string")
    found = entities.resolve_mentions(entities.find_mentions(docs, names))
    rows = {r["norm_key"]: r for r in entities.entities(found).collect()}
    assert rows["acme group"]["doc_count"] == 2 and rows["acme group"]["n_aliases"] == 2 and rows["hr12"]["entity_type"] == "bill"
    assert entities.co_document_edges(found).count() == 2


def test_linkage(spark):
    assert linkage.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    rows = [("1", "Acme Group LLC", "1 Main", "10"), ("2", "Acme Group, LLC", "1 Main", "10"), ("3", "Acme Group L.L.C.", "1 Main", "10"), ("4", "Beacon Partners", "1 Main", "10"), ("5", None, "x", "1")]
    df = spark.createDataFrame(rows, "id string, firm string, address string, zip string")
    r = linkage.records(df, "firm", ["address", "zip"], "id", "corpus")
    got = linkage.merged(linkage.clusters(r, linkage.link_pairs(r, "firm", ["address", "zip"])), "firm").collect()
    assert [x["record_ids"] for x in got] == [["1", "2", "3"]]


def test_connected_long_chains(spark):
    ids = [f"{i:04d}" for i in range(700)]
    random.Random(4).shuffle(ids)
    chains, want = [ids[:400], ids[400:690]], {i: i for i in ids}
    for chain in chains:
        want |= dict.fromkeys(chain, min(chain))
    edges = spark.createDataFrame([(min(p), max(p)) for c in chains for p in zip(c, c[1:], strict=False)], "src string, dst string")
    got = linkage.connected(spark.createDataFrame([(i,) for i in ids], "id string"), edges).collect()
    assert len(got) == 700 and dict(map(tuple, got)) == want
    assert {tuple(r) for r in linkage.connected(spark.createDataFrame([("a",), ("b",)], "id string"), edges.limit(0)).collect()} == {("a", "a"), ("b", "b")}


def test_citations(spark):
    docs = spark.createDataFrame([("d", "Hello\n  Wörld of rails"), ("v", "seen by a model")], "doc_id string, text string").withColumn("text_provenance", F.when(F.col("doc_id") == "v", "vision").otherwise("native"))
    token = lambda d, s, e: docs.filter(F.col("doc_id") == d).select(C.citation_token("doc_id", F.lit(s), F.lit(e), C.span("text", F.lit(s), F.lit(e)))).first()[0]
    good, seen = token("d", 0, 13), token("v", 0, 4)
    claims = [("a", "hello wörld", good), ("b", "never said", good), ("c", "hello", good[:-1] + ("0" if good[-1] != "0" else "1")), ("e", "seen", seen), ("f", "", good), ("g", "x", "nonsense")]
    rows = spark.createDataFrame(claims, "claim string, quote string, token string")
    got = {r["claim"]: r["status"] for r in citations.audit(rows, docs).collect()}
    assert got == {"a": "verified", "b": "unsupported", "c": "invalid_token", "e": "pending_review", "f": "unsupported", "g": "invalid_token"}
    fid = citations.audit(rows, docs).filter("claim = 'e'").first()["finding_id"]
    reviews = spark.createDataFrame([(fid, "confirmed")], "finding_id string, verdict string")
    assert citations.audit(rows, docs, reviews).filter("claim = 'e'").first()["status"] == "verified"
    other = spark.createDataFrame([("d", "Changed text entirely")], "doc_id string, text string")
    assert not citations.verify(rows, docs, other).filter("claim = 'a'").first()["verified"]


def test_search(spark):
    rows = spark.createDataFrame([("1", "the rail safety of bridges"), ("2", "rail rail tax"), ("3", "fish"), ("4", "a well-known rail line")], "chunk_id string, text string")
    assert [r[0] for r in textindex.bm25(rows, "rail tax").collect()] == ["2"]
    assert [r[0] for r in textindex.bm25(rows, "well-known").collect()] == ["4"]
    assert textindex.bm25(rows, "nosuch rail").count() == 0
    docs = spark.createDataFrame([("d", "a phrase\r\nbroken"), ("e", "x")], "doc_id string, text string")
    got = textindex.grep(docs, "PHRASE broken", 1).collect()
    assert [(r["doc_id"], r["total"]) for r in got] == [("d", 1)]


def test_budget(spark):
    docs = spark.createDataFrame([("a", "w " * 100), ("b", "w " * 100), ("c", "w " * 10)], "doc_id string, text string")
    got = [(r["doc_id"], r["status"]) for r in reading.read_documents(docs, ["a", "b", "c", "z"], 90).collect()]
    assert got == [("a", "read"), ("b", "token_budget"), ("c", "read"), ("z", "unknown")]


def test_sql_gate(spark):
    spark.range(5).createOrReplaceTempView("t5")
    assert run_sql(spark, "WITH a AS (SELECT id FROM t5) SELECT * FROM a ORDER BY id DESC", 2).collect()[0][0] == 4
    for bad in ("DROP VIEW t5", "WITH a AS (SELECT 1) INSERT INTO t5 SELECT * FROM a", "CREATE TABLE z AS SELECT 1", "SET x = 1", "CACHE TABLE t5"):
        with pytest.raises(NotReadOnly):
            run_sql(spark, bad)


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"firm": "Acme LLC", "n": 1}]')
    (tmp_path / "b.json").write_text('[{"firm": "Acme LLC", "n": 1}]')
    (tmp_path / "c.md").write_text("# Title\n\nBody text that is long enough.")
    (tmp_path / "d.bin").write_text("x")
    (tmp_path / "e.pdf").write_text("not a pdf")
    found = files.scan(spark, [str(tmp_path)])
    changes = sorted(r["change"] for r in files.ingest(found, None).collect())
    assert changes == ["added", "added", "added", "skipped", "unsupported"]
    docs = {r["source_path"].rsplit("/")[-1]: r for r in files.map_files(found, Settings()).collect()}
    assert docs["a.json"]["text"] == "firm: Acme LLC\nn: 1" and docs["a.json"]["doc_id"] == docs["b.json"]["doc_id"]
    assert docs["c.md"]["title"] == "Title" and docs["e.pdf"]["error"]


def test_index_verifies_against_files(spark, tmp_path):
    from paperlode.api import Index

    corpus = tmp_path / "corpus"
    corpus.mkdir()
    (corpus / "a.json").write_text('{"results": [{"firm": "Acme LLC", "amount": 5}, {"firm": "Zeta", "amount": 7}]}')
    (corpus / "b.txt").write_text("# News\n\nAcme LLC spoke today about bridges.")
    settings = Settings(default=FieldMap(structured_fields=("firm", "amount"), entity_fields=("firm:org",)))
    index = Index(spark, str(tmp_path / "index"), settings)
    index.build([str(corpus)])
    assert index.ingest([str(corpus)]).select("change").distinct().first()[0] == "skipped"
    token = index.search("bridges", mode="keyword").first()["token"]
    assert index.verify(token, "ACME llc  spoke").first()["verified"] and not index.verify(token, "never said").first()["verified"]
    assert index.add_finding("claim", "bridges", token).first()["status"] == "verified"
    assert index.entities().first()["doc_count"] == 2
    (corpus / "b.txt").write_text("# News\n\nSomething else was said altogether.")
    assert index.verify(token, "bridges").first()["source_confirmed"] is False and index.audit().first()["status"] == "unsupported"
    (corpus / "b.txt").unlink()
    assert index.verify(token, "bridges").first()["verified"]
    assert [r["verb"] for r in index.trace(2).collect()] == ["verify", "verify"]

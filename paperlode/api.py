"""An index of a corpus and the questions it answers: one verb a method, DataFrames out.

Tables lie in a store below the index folder; authored memory (observations, findings, reviews, trace) is
append-only and read by its latest rows. Writing verbs replace whole tables by a new version, so a reader
or a failed job never sees half of one.
"""

from __future__ import annotations

import functools
import json
import time
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperlode.config import DEFAULT_TOML, Settings
from paperlode.functions.columns import citation_token, coverage, finding_id, json_field, token_parts
from paperlode.operators import aggregate as agg
from paperlode.operators import anomalies, chunks, citations, entities, linkage, memory, profile, reading, snippets, textindex, topics, vectors
from paperlode.plans.sql_gate import external_table, run_sql
from paperlode.sources import files as src
from paperlode.sources import transcripts
from paperlode.stores import open_store

DERIVED = ("manifest", "documents", "chunks", "vectors", "mentions", "entities", "edges", "clusters", "chunk_clusters", "link_records", "links", "meta", "keyword", "postings")
AUTHORED = ("observations", "findings", "reviews")
_SCHEMAS = {
    "observations": "id bigint, text string, kind string, status string, entity_ids array<string>, doc_ids array<string>, tokens array<string>, updated_at string",
    "findings": "finding_id string, claim string, quote string, token string, created_at string",
    "reviews": "finding_id string, verdict string, reviewer string, note string, at string",
    "trace": "id string, at string, verb string, args string",
    "meta": "key string, value string",
}


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="microseconds")


def _logged(method):
    """Notes the call in the trace; memory of what was asked is part of the answer."""

    @functools.wraps(method)
    def run(self, *args, **options):
        self.log(method.__name__, args=args, **options)
        return method(self, *args, **options)

    return run


class Index:
    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings or Settings()
        self.store = open_store(self.settings.store, spark, self.folder)

    # -- tables

    def has(self, name: str) -> bool:
        return bool(self.store.versions(name))

    def table(self, name: str) -> DataFrame:
        """The newest version of a derived table, or all rows of an authored log."""
        if not self.has(name):
            if name in _SCHEMAS:
                return self.spark.createDataFrame([], _SCHEMAS[name])
            raise LookupError(f"no {name} yet")
        return self.store.log(name) if name in (*AUTHORED, "trace") else self.store.newest(name)

    def _save(self, name: str, df: DataFrame) -> DataFrame:
        return self.store.save(name, df)

    def _append(self, name: str, rows: list[tuple]) -> None:
        self.store.append(name, self.spark.createDataFrame(rows, _SCHEMAS[name]))

    def log(self, verb: str, **args) -> None:
        self._append("trace", [(f"{time.time_ns():020d}", _now(), verb, json.dumps(args, default=str))])

    # -- build

    def init(self) -> str:
        """The index's folder with settings to start from, unless it has some."""
        at = Path(self.folder.removeprefix("file://"), "config.toml")
        at.parent.mkdir(parents=True, exist_ok=True)
        if not at.exists():
            at.write_text(DEFAULT_TOML)
        return str(at)

    def ingest(self, paths: list[str]) -> DataFrame:
        known = self.table("manifest") if self.has("manifest") else None
        found = src.ingest(src.scan(self.spark, paths), known)
        new = found.filter(F.col("change").isin("added", "updated")).select("file_id", "path", "kind", "length", "sha256")
        rest = known.join(new.select("path"), "path", "left_anti").select(*new.columns) if known is not None else None
        self._save("manifest", new if rest is None else rest.unionByName(new))
        return found

    def extract(self, paths: list[str], kinds: tuple[str, ...] | None = None, only_new: bool = True, sidecars: DataFrame | None = None) -> DataFrame:
        """Documents of the manifest's files; those already there are kept when only_new. A transcript beside a
        file (of its present content) goes before its parser, also for documents that are already there."""
        if sidecars is None:
            sidecars = transcripts.beside(self.spark, paths)
        files = src.scan(self.spark, paths).join(self.table("manifest").select("path"), "path", "left_semi")
        if kinds:
            files = files.filter(F.col("kind").isin(*kinds))
        old = self.table("documents").filter("error IS NULL") if only_new and self.has("documents") else None
        if old is not None:
            if sidecars is not None:  # documents that were read before their transcript was made
                old = old.join(sidecars.select("file_id", "sidecar"), "file_id", "left").filter("sidecar IS NULL").drop("sidecar")
            files = files.join(old.select("file_id").distinct(), "file_id", "left_anti")
        docs = src.map_files(files, self.settings, sidecars)
        docs = docs.withColumn("coverage", coverage("pages", "text"))
        if old is not None:
            docs = old.join(self.table("manifest").select("file_id"), "file_id", "left_semi").select(*docs.columns).unionByName(docs)
        return self._save("documents", docs)

    def index(self) -> dict:
        docs = self.table("documents").filter("error IS NULL")
        s = self.settings
        cut = self._save("chunks", chunks.chunk_documents(docs, chunks.ChunkSizes(s.size_tokens, s.overlap_tokens, s.token_factor)))
        path = self.store.new_version("postings")
        textindex.write_index(cut, path, stem=True)
        self._save("keyword", self.spark.createDataFrame([(path,)], "path string"))
        if s.embed:
            self._save("vectors", vectors.embed_chunks(cut, s.embedder, s.contextual))
        declared = docs.select("doc_id", F.posexplode("entities").alias("pos", "e")).select(F.struct("doc_id", "pos").alias("place"), "e.type", "e.name")
        names = entities.gazetteer(declared)
        found = entities.find_mentions(docs, names, s.min_name_len, s.single_word_match)
        found = self._save("mentions", entities.resolve_mentions(found, s.extra_org_suffixes))
        self._save("entities", entities.entities(found))
        self._save("edges", entities.co_document_edges(found))
        meta = {"map_hash": s.map_hash(), "config_hash": s.full_hash(), "embedder": s.embedder if s.embed else "", "indexed_at": _now()}
        self._save("meta", self.spark.createDataFrame(list(meta.items()), _SCHEMAS["meta"]))
        return {"chunks": cut.count(), "mentions": found.count()}

    def build(self, paths: list[str], cluster: bool = False, only_new: bool = True) -> dict:
        """All stages, each timed."""
        stages, out = {}, {}
        steps = [("ingest", lambda: self.ingest(paths).groupBy("change").count().collect()), ("extract", lambda: self.extract(paths, only_new=only_new).count()), ("index", self.index)]
        if cluster:
            steps.append(("cluster", lambda: self.cluster().count()))
        for name, step in steps:
            began = time.time()
            out[name] = step()
            stages[name] = {"duration_s": round(time.time() - began, 3)}
        return {"stages": stages, "results": out}

    def reset(self, hard: bool = False) -> None:
        """Deletes what is derived; with hard also what was authored. The trace stays."""
        for name in (*DERIVED, *(AUTHORED if hard else ())):
            self.store.delete(name)

    # -- search

    def _chunks(self, doc_type: str | None = None, doc_id: str | None = None, path_like: str | None = None, entity: str | None = None) -> DataFrame:
        rows = self.table("chunks")
        docs = self.table("documents").select("doc_id", "source_path", "doc_type", "text_provenance")
        if doc_type:
            docs = docs.filter(F.col("doc_type") == doc_type)
        if doc_id:
            docs = docs.filter(F.col("doc_id") == doc_id)
        if path_like:
            docs = docs.filter(F.col("source_path").ilike(path_like))
        if entity:
            found = entities.lookup_entities(self.table("entities"), entities.aliases(self.table("mentions")), entity)
            spots = self.table("mentions").join(found, "entity_id", "left_semi").select("doc_id", F.col("char_start").alias("m"))
            spots = rows.join(spots, "doc_id").filter("char_start <= m AND m < char_end").select("chunk_id")
            rows = rows.join(spots, "chunk_id", "left_semi")
        return rows.join(docs, "doc_id")

    def search(self, query: str, k: int = 10, mode: str = "auto", rerank: bool = False, min_score: float | None = None, **where) -> DataFrame:
        """rank, chunk_id, doc_id, title, score, match_mode, citation token and snippet of the best chunks."""
        if mode == "auto":
            mode = "hybrid" if self.has("vectors") else "keyword"
        rows = self._chunks(**where)
        pool, limited = max(5 * k, 20), any(v is not None for v in where.values())
        if not query.strip():  # nothing is asked: the first chunks
            hits = rows.orderBy("chunk_id").limit(k)
            place = F.row_number().over(Window.orderBy("chunk_id"))
            return hits.select(place.alias("rank"), "chunk_id", "doc_id", "title", "locator", "source_path", F.lit(0.0).alias("score"), F.lit("all").alias("match_mode"), "text_provenance", citation_token("doc_id", "char_start", "char_end", "text").alias("token"), F.substring("text", 1, snippets.WIDTH).alias("snippet"))
        lists = []
        if mode in ("keyword", "hybrid"):
            if self.has("keyword"):
                found = textindex.indexed_bm25(self.spark, self.table("keyword").first()["path"], query, pool, among=rows if limited else None)
            else:
                found = textindex.bm25(rows, query, pool, stem=True)
            lists.append(found.select(F.col("chunk_id").alias("id"), "score"))
        if mode in ("semantic", "hybrid") and self.has("vectors"):
            q = self.spark.createDataFrame([([float(x) for x in vectors.embedder(self.settings.embedder)([query])[0]],)], "q array<float>")
            near = self.table("vectors").join(rows.select("chunk_id"), "chunk_id", "left_semi")
            lists.append(vectors.nearest(near, q, pool, min_score))
        if not lists:
            return rows.limit(0).select("chunk_id", "doc_id")
        best = textindex.rank_fusion(*lists, k=pool if rerank else k) if len(lists) > 1 else lists[0].orderBy(F.desc("score"), "id").limit(pool if rerank else k)
        hits = rows.join(F.broadcast(best), rows.chunk_id == best.id)  # k rows
        place = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))
        hits = hits.withColumn("rank", place)
        if rerank:
            hits = vectors.rerank(hits.drop("rank"), query, self.settings.reranker or "overlap", k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))
            mode += "+rerank"
        embed = vectors.embedder(self.settings.embedder) if len(lists) > 1 or mode.startswith("semantic") else None
        hits = snippets.window_snippets(hits, self.table("chunks"), query, embed=embed) if embed else snippets.keyword_snippets(hits, query)
        snippet = F.col("snippet")
        out = hits.select("rank", "chunk_id", "doc_id", "title", "locator", "source_path", F.round(1 / F.col("rank"), 4).alias("score"), F.lit(mode).alias("match_mode"), "text_provenance", citation_token("doc_id", "char_start", "char_end", "text").alias("token"), snippet.alias("snippet"))
        return out.orderBy("rank")

    def grep(self, pattern: str, k: int = 20, **where) -> DataFrame:
        return textindex.grep(self._chunks(**where), pattern, k, start_col="char_start")

    def doc(self, doc_id: str) -> dict[str, DataFrame]:
        own = F.col("doc_id") == doc_id
        named = self.table("mentions").filter(own).join(self.table("entities"), "entity_id").select("entity_id", "canonical_name").distinct()
        return {"document": self.table("documents").filter(own).drop("raw", "text"), "chunks": self.table("chunks").filter(own), "entities": named}

    def read(self, doc_ids: list[str], budget: int = 16_000) -> DataFrame:
        return reading.read_documents(self.table("documents"), doc_ids, budget, self.settings.token_factor)

    def sample(self, n: int = 200, budget: int = 8_000, order: str = "random", query: str | None = None, entity: str | None = None, doc_type: str | None = None) -> DataFrame:
        if query or entity:
            rows = self.search(query, n, doc_type=doc_type) if query else self._chunks(entity=entity, doc_type=doc_type)
            ids = [r["doc_id"] for r in rows.select("doc_id").distinct().orderBy("doc_id").limit(n).collect()]
        else:
            ids = reading.sample_ids(self.table("documents"), n, order, where=F.col("doc_type") == doc_type if doc_type else None)
        return self.read(ids, budget)

    # -- fields, aggregates, outliers

    def fields(self) -> DataFrame:
        """Fields by the source (the pattern of its map, or default), from an even sample of documents."""
        sampled = reading.spread_sample(self.table("documents").filter("raw IS NOT NULL"))
        settings = self.settings

        @F.pandas_udf("string")
        def source(paths: pd.Series) -> pd.Series:
            return paths.map(lambda p: settings.map_for(p).match or "default")

        shown = [(m.match or "default", f) for m in (settings.default, *settings.sources) if m.text_fields for f in (*m.text_fields, *m.entity_fields)]
        rendered = self.spark.createDataFrame(shown, "source string, field string")
        return profile.describe_fields(sampled.withColumn("map_source", source("source_path")), rendered, "map_source")

    def _fields(self, *names: str) -> DataFrame:
        """doc_id and structured fields as columns; a field that is a list in any row is an array in all."""
        docs = self.table("documents").filter("structured IS NOT NULL")
        cols = []
        for name in dict.fromkeys(agg.check_field(n) for n in names if n):
            value = json_field("structured", name)
            lists = not docs.filter(value.startswith("[")).isEmpty()
            whole = F.when(value.startswith("["), F.from_json(value, "array<string>")).when(value.isNotNull(), F.array(value))
            cols.append((whole if lists else value).alias(name))
        return docs.select("doc_id", "text", *cols)

    def _canon(self, kind: str | None) -> DataFrame | None:
        return entities.canonical_names(self.table("entities"), kind) if kind else None

    def aggregate(self, by: str, how: str = "count", measure: str | None = None, k: int = 20, resolve: str | None = None) -> DataFrame:
        return agg.aggregate(self._fields(by, measure), by, how, measure, k, self._canon(resolve), resolve or "org")

    def sql(self, statement: str, limit: int = 20, files: dict[str, str] | None = None) -> DataFrame:
        """A read-only query over the index's tables and external files: {name: path of CSV, JSON or Parquet}."""
        for name, path in (files or {}).items():
            external_table(self.spark, name, path)
        for name in (*DERIVED, *AUTHORED):
            if self.has(name):
                self.table(name).createOrReplaceTempView(name)
        return run_sql(self.spark, statement, limit)

    def anomalies(self, mode: str = "peer", by: str | None = None, measure: str = "amount", segment: str | None = "filing_type", resolve: str = "auto", **options) -> DataFrame:
        """Outliers with a citation token of each record's whole text."""
        by = by or ("client.name" if mode == "rare" else "registrant.name")
        kind = anomalies.label_kind(by, resolve)
        rows = self._fields(by, measure, segment)
        canon = self._canon(kind) if kind and self.has("entities") else None
        if mode == "rare":
            found = anomalies.rare_groups(rows, by, measure, canon=canon, kind=resolve, **options)
        else:
            found = anomalies.peer_outliers(rows, by, measure, segment, canon=canon, kind=resolve, **options)
        cited = rows.select("doc_id", citation_token("doc_id", F.lit(0), F.length("text"), "text").alias("token"), F.substring("text", 1, 220).alias("context"))
        return found.join(cited, "doc_id")

    def peek(self, path: str, sample: int = 50) -> dict:
        """Fields of the records in files, and a field map to start from."""
        settings = self.settings
        rows = src.map_files(src.scan(self.spark, [path]).filter(F.col("kind").isin("json", "jsonl", "xml")), settings).filter("raw IS NOT NULL")
        found = profile.peek_fields(rows, "raw", sample)
        sources = profile.peek_folder(rows.select(F.col("source_path").alias("path"), "raw"))
        return {"sources": sources, "fields": found, "suggested": profile.suggest_map(found)}

    # -- entities, linkage, topics

    def entities(self, kind: str | None = None, name: str | None = None, min_count: int = 1, k: int = 50) -> DataFrame:
        return entities.list_entities(self.table("entities"), kind, name, min_count, k)

    def entity(self, entity_id: str) -> dict[str, DataFrame]:
        return entities.entity_detail(self.table("mentions"), self.table("edges"), entity_id)

    def reconcile(self, on: str, compare: list[str] | None = None, threshold: float = 0.9, link_path: str | None = None, train: bool = False, least_link: float = 0.5) -> dict:
        compare = [c for c in compare or [] if c != on]
        rows = linkage.records(self._fields(on, *compare), on, compare, "doc_id", "corpus")
        if link_path:
            rows = rows.unionByName(src.link_dataset(self.spark, link_path, on, compare))
        if rows.limit(2).count() < 2:
            return {"error": f"two records with {on!r} at least are needed"}
        levels = linkage.trained_levels(rows, on) if train else None
        pairs = linkage.link_pairs(rows, on, compare, levels)
        run = datetime.now(UTC).strftime("rec_%Y%m%d%H%M%S")
        links = self._save("links", pairs.filter(F.col("match_probability") >= min(least_link, threshold)).withColumn("run_id", F.lit(run)))
        found = self._save("link_records", linkage.clusters(rows, links, threshold).withColumn("run_id", F.lit(run)))
        return {"run_id": run, "threshold": threshold, "n_records": found.count(), "n_clusters": found.select("cluster_id").distinct().count(), "clusters": linkage.merged(found, on)}

    def cluster(self, k: int | str | None = None) -> DataFrame:
        found = topics.cluster_vectors(self.table("vectors"), self.settings.clusters if k is None else k)
        found = self._save("chunk_clusters", found.withColumnRenamed("id", "chunk_id"))
        terms = topics.cluster_terms(found.join(self.table("chunks").select("chunk_id", "text"), "chunk_id").select("cluster", "text"))
        labels = terms.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), ", ").alias("label"))
        sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).join(labels, "cluster", "left")
        return self._save("clusters", sizes).orderBy(F.desc("size"), "cluster")

    # -- citations and memory

    def reconcile_show(self, run: str | None = None) -> DataFrame:
        """Clusters of several records of a linkage run, the newest by default."""
        rows = self.table("link_records")
        if run is not None and rows.filter(F.col("run_id") == run).isEmpty():
            raise KeyError(f"no run {run!r}")
        rows = rows if run is None else rows.filter(F.col("run_id") == run)
        name = next(c for c in rows.columns if c not in ("record_id", "source", "cluster_id", "run_id"))
        return linkage.merged(rows, name)

    def _sources(self, cited: DataFrame) -> DataFrame | None:
        """Texts of cited(token) derived again from the source files, by path and locator, with the parser
        and the transcript each was read by; files that are gone have none. Files are opened where the
        rows are, so no list of them reaches the driver."""
        docs = self.table("documents")
        docs = docs if "parser" in docs.columns else docs.withColumn("parser", F.lit(None).cast("string"))
        wanted = cited.select(token_parts("token")["doc_id"].alias("doc_id")).distinct().join(docs.select("doc_id", "source_path", "locator", "parser", "text_provenance"), "doc_id")
        transcribed = wanted.groupBy("source_path").agg(F.max("parser").alias("parser"), F.bool_or(F.col("text_provenance") != "native").alias("transcribed"))
        again = src.read_again(transcribed, self.settings).filter("error IS NULL")
        return wanted.join(again.select("source_path", "locator", "text"), ["source_path", "locator"]).select("doc_id", "text")

    def cite(self, token: str) -> DataFrame:
        rows = self.spark.createDataFrame([(token,)], "token string")
        return citations.resolve(rows, self.table("documents"), sources=self._sources(rows))

    def verify(self, token: str, quote: str) -> DataFrame:
        rows = self.spark.createDataFrame([(token, quote)], "token string, quote string")
        return citations.verify(rows, self.table("documents"), self._sources(rows))

    def add_finding(self, claim: str, quote: str, token: str) -> DataFrame:
        rows = self.spark.createDataFrame([(claim, quote, token)], "claim string, quote string, token string").withColumn("finding_id", finding_id("claim", "token", "quote"))
        self._append("findings", [(rows.first()["finding_id"], claim, quote, token, _now())])
        return self.audit().filter(F.col("claim") == claim)

    def findings(self) -> DataFrame:
        return memory.latest(self.table("findings"), ["finding_id"], ["created_at"]).orderBy("created_at")

    def audit(self) -> DataFrame:
        reviews = memory.latest(self.table("reviews"), ["finding_id"], ["at"])
        findings = self.findings().drop("finding_id")
        return citations.audit(findings, self.table("documents"), reviews, self._sources(findings))

    def review(self, finding: str, confirm: bool, reviewer: str = "", note: str = "") -> DataFrame:
        if self.findings().filter(F.col("finding_id") == finding).isEmpty():
            raise KeyError(f"no finding {finding!r}")
        self._append("reviews", [(finding, "confirmed" if confirm else "rejected", reviewer, note, _now())])
        return self.audit().filter(F.col("finding_id") == finding)

    def note(self, text: str, kind: str = "note", status: str = "open", entity_ids=(), doc_ids=(), tokens=()) -> int:
        if kind not in memory.KINDS or status not in memory.STATUSES:
            raise ValueError(f"kind must be one of {memory.KINDS}, status one of {memory.STATUSES}")
        ident = time.time_ns()
        self._append("observations", [(ident, text, kind, status, list(entity_ids), list(doc_ids), list(tokens), _now())])
        return ident

    def notes(self, status: str | None = None, kind: str | None = None, entity: str | None = None, k: int | None = 50) -> DataFrame:
        return memory.list_observations(memory.latest(self.table("observations"), ["id"], ["updated_at"]), status, kind, entity, k)

    def update_note(self, ident: int, status: str | None = None, text: str | None = None) -> None:
        held = memory.latest(self.table("observations"), ["id"], ["updated_at"]).filter(F.col("id") == ident).first()
        if held is None:
            raise KeyError(f"no observation {ident}")
        if status and status not in memory.STATUSES:
            raise ValueError(f"status must be one of {memory.STATUSES}")
        row = held.asDict() | {"status": status or held["status"], "text": text or held["text"], "updated_at": _now()}
        self._append("observations", [tuple(row[c.split()[0]] for c in _SCHEMAS["observations"].split(", "))])

    def recall(self, query: str, k: int = 8, mode: str = "keyword", status: str | None = None, kind: str | None = None, entity: str | None = None) -> DataFrame:
        """Observations (of a status, kind or entity) and findings that answer to a query; findings have none
        of the three, so they are left out where one is asked for."""
        both = self.notes(status, kind, entity, k=None).select(F.col("id").cast("string").alias("id"), F.lit("observation").alias("source"), "text")
        if not (status or kind or entity):
            known = self.findings().select(F.col("finding_id").alias("id"), F.lit("finding").alias("source"), F.concat_ws(" ", "claim", "quote").alias("text"))
            both = both.unionByName(known)
        return memory.recall(both, query, k) if mode == "keyword" else memory.recall_vectors(both, query, k, self.settings.embedder)

    # -- scanned files

    def _scanned(self, path: str | None) -> list[str]:
        """The PDF files in question: one, or all of the manifest (their paths reach the driver, as pages of
        each are rendered there by hand or by a model)."""
        if path:
            return [path]
        rows = self.table("manifest").filter("kind = 'pdf'").select("path").orderBy("path")
        return [r["path"].removeprefix("file:") for r in rows.toLocalIterator()]

    def render(self, path: str | None = None, dpi: int = 150, pages: str | None = None, force: bool = False) -> list[dict]:
        """Writes the pages of PDF files as images beside the index's tables; those there stay unless forced."""
        return [{"path": p, "images": transcripts.write_images(p, f"{self.folder.removeprefix('file://')}/images", dpi, pages, force)} for p in self._scanned(path)]

    def ocr(self, path: str | None = None, dpi: int = 300, lang: str = "eng", pages: str | None = None, force: bool = False) -> list[str]:
        """Reads the pages of scanned files into transcripts; extract takes them from there."""
        return [str(transcripts.ocr_file(p, dpi, lang, pages=pages, force=force)) for p in self._scanned(path)]

    def transcribe_status(self, path: str | None = None) -> list[dict]:
        """Which files have a transcript, whether it is stale, and pages with an image but no transcript."""
        return [transcripts.state(p, f"{self.folder.removeprefix('file://')}/images") for p in self._scanned(path)]

    def transcribe_import(self, path: str, drafts: dict, model: str) -> str:
        """A model's reading of pages (number: text); each must have been rendered."""
        images = transcripts.images_of(path, f"{self.folder.removeprefix('file://')}/images")
        return str(transcripts.import_vision(path, {int(n): t for n, t in drafts.items()}, images, model))

    @staticmethod
    def verbs() -> tuple[str, ...]:
        return ("ingest", "extract", "build", "reset", "search", "grep", "doc", "read", "sample", "fields", "aggregate", "sql", "anomalies", "peek", "entity", "reconcile", "cluster", "cite", "verify", "add_finding", "review", "note", "update_note", "recall", "coverage", "status", "init", "render", "ocr", "transcribe_status", "transcribe_import", "reconcile_show")

    def trace(self, n: int = 20) -> DataFrame:
        return memory.tail(self.table("trace"), n)

    def coverage(self) -> DataFrame:
        parsed = self.table("documents").filter(F.col("doc_type").isin("pdf", "docx", "txt", "md") & F.col("error").isNull())
        return profile.coverage_report(parsed)

    def status(self) -> dict:
        meta = {r["key"]: r["value"] for r in self.table("meta").collect()}
        out = {"counts": {n: self.table(n).count() for n in DERIVED if self.has(n)}, "meta": meta, "map_drift": bool(meta) and meta.get("map_hash") != self.settings.map_hash()}
        if self.has("documents"):
            docs = self.table("documents")
            out["errors"] = [r.asDict() for r in docs.filter("error IS NOT NULL").select("source_path", "error").limit(50).collect()]
            out["inertia"] = profile.inertia_notice(docs, out["counts"].get("entities", 0))
            out["notice"] = profile.coverage_notice(docs.filter(F.col("doc_type").isin("pdf", "docx", "txt", "md")))
        out["open"] = [r.asDict() for r in memory.open_threads(memory.latest(self.table("observations"), ["id"], ["updated_at"])).collect()]
        return out


for _verb in Index.verbs():
    setattr(Index, _verb, _logged(getattr(Index, _verb)))

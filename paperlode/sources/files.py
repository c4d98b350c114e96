"""Ingest of files: manifest, delta against what is known, and documents of every kind of file."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.config import Settings
from paperlode.functions.columns import id_of_digest
from paperlode.sources import records

MAPPED = {".json": "json", ".jsonl": "jsonl", ".xml": "xml"}
PARSED = {".pdf": "pdf", ".docx": "docx", ".txt": "txt", ".md": "md", ".markdown": "md", ".text": "txt"}
#: Folder of our own tables below a corpus, which is never ingested.
OWN_FOLDER = ".paperlode"
PAGES = "array<struct<number:int,char_start:int,char_end:int,page_class:string,tier:string>>"
DOCUMENT = f"doc_id string, file_id string, source_path string, doc_type string, locator string, title string, text string, structured string, raw string, entities array<struct<type:string,name:string>>, pages {PAGES}, text_provenance string, map_hash string, error string, parser string"


def kind_of(path):
    """json, jsonl, xml, pdf, docx, txt, md or unsupported, by the suffix."""
    suffix = F.lower(F.regexp_extract(path if not isinstance(path, str) else F.col(path), r"(\.[^./]+)$", 1))
    out = None
    for ext, kind in (MAPPED | PARSED).items():
        out = F.when(suffix == ext, kind) if out is None else out.when(suffix == ext, kind)
    return out.otherwise("unsupported")


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, kind, content, length, sha256, file_id of all files below paths, our own folder aside. Content
    is read (and hashed) only of files of a kind that is supported; others have none."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    found = found.filter(~F.col("path").contains(f"/{OWN_FOLDER}/")).withColumn("kind", kind_of("path"))
    digest = F.when(F.col("kind") == "unsupported", F.sha2(F.col("path").cast("binary"), 256)).otherwise(F.sha2("content", 256))
    return found.withColumn("sha256", digest).select("path", "kind", "content", "length", "sha256", id_of_digest("sha256").alias("file_id"))


def ingest(files: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Manifest rows (file_id, path, kind, length, sha256, change: added, updated, skipped or unsupported).

    Content decides, by its whole SHA-256: a known content is skipped wherever it lies, another content at a
    known path updates it, and of equal contents the first path counts."""
    rows = files.select("path", "kind", "file_id", "length", "sha256")
    first = rows.groupBy("sha256").agg(F.min("path").alias("first_path"))
    rows = rows.join(first, "sha256")
    if manifest is not None:
        known = manifest.select("sha256", F.lit(True).alias("known")).distinct()
        paths = manifest.select("path", F.lit(True).alias("seen")).distinct()
        rows = rows.join(known, "sha256", "left").join(paths, "path", "left")
    else:
        rows = rows.withColumns({"known": F.lit(None).cast("boolean"), "seen": F.lit(None).cast("boolean")})
    change = F.when(F.col("kind") == "unsupported", "unsupported").when(F.col("known"), "skipped").when(F.col("path") != F.col("first_path"), "skipped").when(F.col("seen"), "updated").otherwise("added")
    return rows.select("file_id", "path", "kind", "length", "sha256", change.alias("change"))


def _document(fid: str, i: int, path: str, kind: str, locator: str, title: str, text: str, map_hash: str, **more) -> dict:
    base = {"doc_id": f"{fid}.{i}", "file_id": fid, "source_path": path, "doc_type": "json" if kind == "jsonl" else kind, "locator": locator, "title": title, "text": text, "structured": None, "raw": None, "entities": [], "pages": None, "text_provenance": "native", "map_hash": map_hash, "error": None, "parser": None}
    return base | more


def documents_of(content: bytes, kind: str, fid: str, path: str, settings: Settings, sidecar: str | None = None, parser: str | None = None) -> list[dict]:
    """The documents of one file; a file that can't be read whole gives one row with its error and no text.

    parser: the one that read the file before, so that it is read in the same way again."""
    try:
        if sidecar is not None and kind in ("pdf", "docx", "md", "txt"):
            return [_from_sidecar(json.loads(sidecar), fid, path, kind)]
        if kind in ("txt", "md"):
            text = content.decode("utf-8", "replace")
            heads = [x.strip() for x in text.splitlines() if x.strip()]
            pages = [{"number": 1, "char_start": 0, "char_end": len(text), "page_class": page_class(text), "tier": "native"}]
            return [_document(fid, 0, path, kind, "", heads[0].lstrip("# ") if heads else PurePosixPath(path).stem, text, "", pages=pages)]
        if kind in ("pdf", "docx"):
            from paperlode.sources.adapters import parse

            parser = parser or settings.parsers.get(kind, kind)
            text, pages, name = parse(kind, parser, content)
            return [_document(fid, 0, path, kind, "", name or PurePosixPath(path).stem, text, "", pages=pages, parser=parser)]
        fields, out = settings.map_for(path), []
        for i, (locator, rec) in enumerate(records.file_records(content, kind, fields)):
            text = records.render(rec, fields)
            held = records.structured(rec, fields.structured_fields)
            out.append(_document(fid, i, path, kind, locator, records.title(rec, locator, text, fields, kind, PurePosixPath(path).stem), text, settings.map_hash(), structured=json.dumps(held, ensure_ascii=False), raw=json.dumps(rec, ensure_ascii=False), entities=records.declared_entities(rec, fields.entity_fields)))
        return out
    except Exception as e:  # whatever a file holds must not end the others; its error is a row
        return [_document(fid, -1, path, kind, "", "", "", "", error=f"{type(e).__name__}: {e}")]


def page_class(text: str) -> str:
    """As functions.columns.page_class, for text that is in Python anyway."""
    if len(text.strip()) < 20:
        return "empty"
    if sum(c.isascii() and c.isalnum() for c in text) < 0.5 * len(text):
        return "bad_ocr"
    return "table" if text.count("\t") > 5 or text.count("  ") > 0.3 * text.count(" ") else "text"


def _from_sidecar(data: dict, fid: str, path: str, kind: str) -> dict:
    """A document out of the transcript beside its file; pages are joined by the transcript's separator."""
    sep, text, pages = data.get("page_sep", "\n\n"), "", []
    for i, p in enumerate(sorted(data.get("pages", []), key=lambda p: p["page_no"])):
        text += sep if i else ""
        pages.append({"number": p["page_no"], "char_start": len(text), "char_end": len(text) + len(p.get("text", "")), "page_class": p.get("page_class") or page_class(p.get("text", "")), "tier": p.get("tier", data.get("text_provenance", "ocr"))})
        text += p.get("text", "")
    return _document(fid, 0, path, kind, "", PurePosixPath(path).stem, text, "", pages=pages, text_provenance=data.get("text_provenance", "ocr"))


def map_files(files: DataFrame, settings: Settings, sidecars: DataFrame | None = None) -> DataFrame:
    """Documents of files(path, kind, content, file_id[, parser]). sidecars(file_id, sidecar): transcripts, which
    win over parsers. parser: what a file was read by before."""
    rows = files.filter("kind <> 'unsupported'")
    rows = rows.join(sidecars, "file_id", "left") if sidecars is not None else rows.withColumn("sidecar", F.lit(None).cast("string"))
    rows = rows if "parser" in files.columns else rows.withColumn("parser", F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = list(_document("", 0, "", "", "", "", "", ""))
        for f in frames:
            for r in f.itertuples(index=False):
                yield pd.DataFrame(documents_of(r.content, r.kind, r.file_id, r.path.removeprefix("file:"), settings, r.sidecar, r.parser), columns=names)

    return rows.select("path", "kind", "content", "file_id", "sidecar", "parser").mapInPandas(run, DOCUMENT)


def read_again(files: DataFrame, settings: Settings) -> DataFrame:
    """Documents of files(source_path, parser, transcribed) as they lie now; what is gone gives none.

    A file is opened by the task that has its row, through pyarrow's file systems. transcribed: the document
    came of the transcript beside the file, which is read again, unless the file has changed since."""
    kinds = MAPPED | PARSED

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from paperlode.sources.transcripts import SUFFIX

        names = list(_document("", 0, "", "", "", "", "", ""))
        for f in frames:
            for path, parser, transcribed in f.itertuples(index=False):
                content = _bytes_of(path)
                if content is None:
                    continue
                digest = hashlib.sha256(content).hexdigest()
                sidecar = _bytes_of(path + SUFFIX) if transcribed else None
                if sidecar is not None and json.loads(sidecar).get("source_sha256") != digest:
                    sidecar = None
                kind = kinds.get(PurePosixPath(path).suffix.lower(), "unsupported")
                yield pd.DataFrame(documents_of(content, kind, f"f{digest[:10]}", path, settings, None if sidecar is None else sidecar.decode("utf-8"), parser), columns=names)

    return files.select("source_path", "parser", "transcribed").mapInPandas(run, DOCUMENT)


def _bytes_of(path: str) -> bytes | None:
    store, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    if store.get_file_info(at).type != fs.FileType.File:
        return None
    with store.open_input_stream(at) as f:
        return f.read()


def link_dataset(spark: SparkSession, path: str, on: str, compare: list[str]) -> DataFrame:
    """record_id (ext:i), source (link:file), name and fields of an external JSON list, or of the first
    list in an object."""
    wanted = [on, *(c for c in compare if c != on)]
    source = f"link:{PurePosixPath(path).name}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for text in f["value"]:
                data = json.loads(text)
                if isinstance(data, dict):
                    data = next((v for v in data.values() if isinstance(v, list)), [])
                rows = [(f"ext:{i}", source, *(None if r.get(c) is None else str(r[c]).strip() or None for c in wanted)) for i, r in enumerate(data) if isinstance(r, dict)]
                yield pd.DataFrame(rows, columns=["record_id", "source", *wanted])

    fields = ", ".join(f"`{c}` string" for c in wanted)
    return spark.read.text(path, wholetext=True).mapInPandas(run, f"record_id string, source string, {fields}").filter(F.col(on).isNotNull())

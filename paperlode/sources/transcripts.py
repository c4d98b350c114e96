"""Transcripts beside scanned files: written by OCR or by a model's reading, and read back as documents."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable
from datetime import UTC, datetime
from pathlib import Path

SUFFIX = ".transcript.json"
TIERS = ("ocr", "vision")


def page_numbers(spec: str, last: int) -> list[int]:
    """Pages of "1-20,41", within 1 to last."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        first, _, end = part.partition("-")
        out |= set(range(int(first), int(end or first) + 1))
    return sorted(p for p in out if 1 <= p <= last)


def transcript_path(source: str) -> Path:
    return Path(source + SUFFIX)


def sha256_of(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def write_transcript(source: str, pages: Iterable[dict], tier: str, engine: str, page_sep: str = "\n\n") -> Path:
    """pages: page_no, text, perhaps page_class and confidence. Pages of an older transcript that aren't
    given again stay. The file appears whole or not at all."""
    if tier not in TIERS:
        raise ValueError(f"tier must be one of {TIERS}")
    at = transcript_path(source)
    held = {p["page_no"]: p for p in (json.loads(at.read_text())["pages"] if at.exists() else [])}
    held |= {p["page_no"]: {"tier": tier, **p} for p in pages}
    data = {"source_sha256": sha256_of(source), "engine": engine, "text_provenance": "vision" if any(p.get("tier") == "vision" for p in held.values()) else "ocr", "page_sep": page_sep, "created_at": datetime.now(UTC).isoformat(timespec="seconds"), "pages": [held[k] for k in sorted(held)]}
    draft = at.with_suffix(".tmp")
    draft.write_text(json.dumps(data, ensure_ascii=False))
    os.replace(draft, at)
    return at


def is_stale(source: str) -> bool | None:
    """Whether the source has changed since it was transcribed; None without a transcript."""
    at = transcript_path(source)
    return None if not at.exists() else json.loads(at.read_text())["source_sha256"] != sha256_of(source)


def remaining_pages(source: str, n_pages: int) -> list[int]:
    """Pages that no transcript has."""
    at = transcript_path(source)
    done = {p["page_no"] for p in json.loads(at.read_text())["pages"]} if at.exists() else set()
    return [p for p in range(1, n_pages + 1) if p not in done]


def import_vision(source: str, drafts: dict[int, str], images: dict[int, str], model: str) -> Path:
    """A model's reading of page images; a page without its image can't be reviewed and is refused."""
    bare = sorted(p for p in drafts if p not in images or not Path(images[p]).exists())
    if bare:
        raise ValueError(f"pages {bare} have no rendered image")
    return write_transcript(source, ({"page_no": p, "text": t} for p, t in drafts.items()), "vision", model)


def ocr_file(source: str, dpi: int = 300, lang: str = "eng", mode: int = 3, pages: str | None = None, force: bool = False) -> Path:
    """Reads the pages of a scanned file that have no transcript yet (all with force)."""
    from paperlode.sources.adapters import ocr_page, render_pages
    from paperlode.sources.files import page_class

    images = render_pages(Path(source).read_bytes(), dpi)
    wanted = page_numbers(pages, len(images)) if pages else range(1, len(images) + 1)
    todo = [p for p in wanted if force or p in set(remaining_pages(source, len(images)))]
    rows = []
    for p in todo:
        text, sure = ocr_page(images[p - 1], lang, mode)
        kind = page_class(text)
        rows.append({"page_no": p, "text": text, "confidence": round(sure, 1), "page_class": "bad_ocr" if kind == "text" and sure < 45 else kind})
    return write_transcript(source, rows, "ocr", "tesseract")


def transcripts(spark, folder: str):
    """file_id, sidecar of the transcripts below a folder, by the hash of the file each was made of."""
    return _sidecars(spark, [folder])


def beside(spark, paths: list[str]):
    """As transcripts(), below several paths; None where there is none."""
    found = _sidecars(spark, paths)
    return None if found is None or found.isEmpty() else found


def _sidecars(spark, paths: list[str]):
    from pyspark.sql import functions as F

    from paperlode.functions.columns import id_of_digest

    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{SUFFIX}").text(paths, wholetext=True)
    found = rows.select(id_of_digest(F.get_json_object("value", "$.source_sha256")).alias("file_id"), F.col("value").alias("sidecar"))
    return found.filter("file_id IS NOT NULL").groupBy("file_id").agg(F.max("sidecar").alias("sidecar"))


def image_path(source: str, folder: str, page: int) -> Path:
    """Where the image of a page lies: by the content of its file, so an edited one has images of its own."""
    return Path(folder, sha256_of(source)[:16], f"page-{page:05d}.png")


def images_of(source: str, folder: str) -> dict[int, str]:
    at = image_path(source, folder, 0).parent
    return {int(p.stem.split("-")[1]): str(p) for p in sorted(at.glob("page-*.png"))}


def write_images(source: str, folder: str, dpi: int = 150, pages: str | None = None, force: bool = False) -> list[str]:
    """Writes the pages of a file as images and gives their paths; those there stay unless forced."""
    from paperlode.sources.adapters import render_pages

    images = render_pages(Path(source).read_bytes(), dpi)
    out = []
    for n in page_numbers(pages, len(images)) if pages else range(1, len(images) + 1):
        at = image_path(source, folder, n)
        if force or not at.exists():
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(images[n - 1])
        out.append(str(at))
    return out


def state(source: str, folder: str) -> dict:
    """path, transcribed, stale, waiting: pages with an image that no transcript has."""
    images = images_of(source, folder)
    left = remaining_pages(source, max(images, default=0))
    return {"path": source, "transcribed": transcript_path(source).exists(), "stale": is_stale(source), "waiting": [n for n in left if n in images]}

"""Optional readers of PDF, DOCX and page images. Each needs a library that may be missing, which the
error says; the registry takes others."""

from __future__ import annotations

import io
from collections.abc import Callable

from paperlode.operators.vectors import NotInstalled

PARSERS: dict[tuple[str, str], Callable] = {}


def register_parser(kind: str, name: str):
    def add(f):
        PARSERS[kind, name] = f
        return f

    return add


def parse(kind: str, name: str, content: bytes):
    """text, pages, title of a file's bytes."""
    if (kind, name) not in PARSERS:
        raise KeyError(f"no parser {name!r} for {kind}")
    return PARSERS[kind, name](content)


def _paged(texts: list[str], tier: str = "native"):
    from paperlode.sources.files import page_class

    text, pages = "", []
    for i, t in enumerate(texts):
        text += "\n\n" if i else ""
        pages.append({"number": i + 1, "char_start": len(text), "char_end": len(text) + len(t), "page_class": page_class(t), "tier": tier})
        text += t
    return text, pages


@register_parser("pdf", "pdfium")
def _pdfium(content: bytes):
    try:
        import pypdfium2
    except ImportError as e:
        raise NotInstalled("reading PDF files needs pypdfium2") from e
    doc = pypdfium2.PdfDocument(content)
    return *_paged([p.get_textpage().get_text_range() for p in doc]), None


@register_parser("pdf", "pymupdf")
def _pymupdf(content: bytes):
    try:
        import fitz
    except ImportError as e:
        raise NotInstalled("the pymupdf parser needs pymupdf") from e
    doc = fitz.open(stream=content, filetype="pdf")
    return *_paged([p.get_text() for p in doc]), (doc.metadata or {}).get("title")


@register_parser("pdf", "docling")
@register_parser("docx", "docling")
def _docling(content: bytes):
    try:
        from docling.datamodel.base_models import DocumentStream
        from docling.document_converter import DocumentConverter
    except ImportError as e:
        raise NotInstalled("the docling parser needs docling") from e
    text = DocumentConverter().convert(DocumentStream(name="file", stream=io.BytesIO(content))).document.export_to_markdown()
    return *_paged([text], "ocr"), None


@register_parser("docx", "docx")
def _docx(content: bytes):
    try:
        import docx
    except ImportError as e:
        raise NotInstalled("reading DOCX files needs python-docx") from e
    return *_paged(["\n".join(p.text for p in docx.Document(io.BytesIO(content)).paragraphs)]), None


def render_pages(content: bytes, dpi: int = 150) -> list[bytes]:
    """PNG images of the pages of a PDF."""
    try:
        import pypdfium2
    except ImportError as e:
        raise NotInstalled("rendering pages needs pypdfium2 and pillow") from e
    out = []
    for page in pypdfium2.PdfDocument(content):
        held = io.BytesIO()
        page.render(scale=dpi / 72).to_pil().convert("L").save(held, "PNG")
        out.append(held.getvalue())
    return out


def ocr_page(image: bytes, lang: str = "eng", mode: int = 3) -> tuple[str, float]:
    """Text and mean confidence of a page image."""
    import shutil
    import subprocess

    if not shutil.which("tesseract"):
        raise NotInstalled("OCR needs tesseract")
    rows = subprocess.run(["tesseract", "stdin", "stdout", "-l", lang, "--psm", str(mode), "tsv"], input=image, capture_output=True, check=True).stdout.decode("utf-8", "replace").splitlines()[1:]
    words = [r.split("\t") for r in rows if len(r.split("\t")) == 12 and r.split("\t")[11].strip() and float(r.split("\t")[10]) >= 0]
    text: dict[tuple, list[str]] = {}
    for w in words:
        text.setdefault(tuple(w[1:5]), []).append(w[11])
    scores = [float(w[10]) for w in words]
    return "\n".join(" ".join(v) for v in text.values()), sum(scores) / len(scores) if scores else 0.0

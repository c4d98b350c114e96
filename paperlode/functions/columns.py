"""Column builders: identities, citation tokens, name keys, page classes, vectors. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms that don't tell organisations apart (fixed values).
LEGAL_FORMS = ("llc", "inc", "incorporated", "corp", "corporation", "co", "company", "lp", "llp", "pllc", "pc", "ltd", "limited", "plc", "the")
#: References to bills (fixed pattern), as Java and Python read it.
BILL_PATTERN = r"\b(?:H\.?\s?R\.?|S\.?J\.?\s?Res\.?|H\.?J\.?\s?Res\.?|S\.?)\s?\d{1,6}\b"
#: Characters below which a page counts as blank.
LEAST_PAGE_CHARS = 20
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def file_id(content) -> Column:
    """Id of a source file by its bytes: the same content has the same id wherever it lies."""
    return id_of_digest(F.sha2(_c(content), 256))


def id_of_digest(sha256) -> Column:
    """The short id of a file for tokens and joins of its documents; whether a file is known its whole digest decides."""
    return F.concat(F.lit("f"), F.substring(_c(sha256), 1, 10))


def entity_id(kind, key) -> Column:
    return F.concat(F.lit("e_"), F.substring(F.sha1(F.concat_ws("|", _c(kind), _c(key)).cast("binary")), 1, 12))


def finding_id(claim, token, quote) -> Column:
    return F.concat(F.lit("find_"), F.substring(F.sha1(F.concat_ws("|", _c(claim), _c(token), _c(quote)).cast("binary")), 1, 10))


def span(text, start, end) -> Column:
    """Code points [start, end) of a text."""
    return F.substring(_c(text), _c(start) + 1, _c(end) - _c(start))


def span_hash(start, end, piece) -> Column:
    parts = F.concat_ws("\x1f", _c(start).cast("string"), _c(end).cast("string"), _c(piece))
    return F.substring(F.sha2(parts, 256), 1, 8)


def citation_token(doc_id, start, end, piece) -> Column:
    """doc_id@start-end#hash: changes with the place and with every character of the span."""
    return F.concat(_c(doc_id).cast("string"), F.lit("@"), _c(start).cast("string"), F.lit("-"), _c(end).cast("string"), F.lit("#"), span_hash(start, end, piece))


TOKEN_PATTERN = r"^(.+)@(\d+)-(\d+)#([0-9a-f]{8})$"


def token_parts(token) -> Column:
    """doc_id, start, end, hash of a token; all null where it isn't one."""
    t = _c(token)
    ok = t.rlike(TOKEN_PATTERN)
    part = lambda k: F.when(ok, F.regexp_extract(t, TOKEN_PATTERN, k))
    return F.struct(part(1).alias("doc_id"), part(2).cast("int").alias("start"), part(3).cast("int").alias("end"), part(4).alias("hash"))


def name_key(name, kind="org", more_forms: tuple[str, ...] = ()) -> Column:
    """Key under which spellings of a name meet. Bills lose dots and blanks; organisations lose legal
    forms, unless nothing else is left. kind: a type or a column of types."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    low = F.regexp_replace(F.lower(_c(name)), r"\.", "")
    words = F.filter(F.split(F.regexp_replace(low, r"(?U)[^\w\s&]", " "), r"(?U)\s+"), lambda w: w != "")
    bare = F.filter(words, lambda w: ~w.isin(*LEGAL_FORMS, *more_forms))
    words = F.when((kind == "org") & (F.size(bare) > 0), bare).otherwise(words)
    return F.when(kind == "bill", F.regexp_replace(low, r"(?U)\s+", "")).otherwise(F.array_join(words, " "))


def number(value) -> Column:
    """A finite number, or null for whatever doesn't read as one."""
    v = _c(value).cast("string")
    x = F.when(v.rlike(NUMBER), F.trim(v).try_cast("double"))
    return F.when(F.abs(x) < float("inf"), x)


def json_field(json, field: str) -> Column:
    """The value of one flat key (which may hold dots) as text."""
    return F.get_json_object(_c(json), "$['" + field.replace("'", "\\'") + "']")


def word_count(text) -> Column:
    words = F.split(F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " ")), " ")
    return F.size(F.filter(words, lambda w: w != ""))


def token_estimate(text, factor: float = 0.75) -> Column:
    return F.floor(word_count(text) * F.lit(factor)).cast("int")


def page_class(text) -> Column:
    """empty, bad_ocr, table or text, by the content of a page."""
    t = _c(text)
    n = F.length(t)
    stripped = F.length(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))
    alnum = n - F.length(F.regexp_replace(t, "[A-Za-z0-9]", ""))
    blanks = n - F.length(F.replace(t, F.lit(" "), F.lit("")))
    pairs = (n - F.length(F.replace(t, F.lit("  "), F.lit("")))) / 2
    tabs = n - F.length(F.replace(t, F.lit("\t"), F.lit("")))
    table = (tabs > 5) | (pairs > blanks * F.lit(0.3))
    return F.when(stripped < LEAST_PAGE_CHARS, "empty").when(alnum / F.greatest(n, F.lit(1)) < 0.5, "bad_ocr").when(table, "table").otherwise("text")


def coverage(pages, text) -> Column:
    """Share of page spans that hold text; a document without pages counts as one."""
    pages, t = _c(pages), _c(text)
    full = F.filter(pages, lambda p: (p["char_end"] - p["char_start"]) >= LEAST_PAGE_CHARS)
    whole = F.length(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")) >= LEAST_PAGE_CHARS
    return F.when(F.coalesce(F.size(pages), F.lit(0)) <= 0, whole.cast("double")).otherwise(F.size(full) / F.size(pages))


def coverage_verdict(share) -> Column:
    return F.when(_c(share) >= 0.7, "native").when(_c(share) >= 0.1, "sparse").otherwise("image_only")


def page_of(pages, offset) -> Column:
    """The page whose span holds an offset, else the last one."""
    pages, at = _c(pages), _c(offset)
    holding = F.filter(pages, lambda p: (p["char_start"] <= at) & (at < p["char_end"]))
    return F.when(F.size(pages) > 0, F.coalesce(F.get(holding, F.lit(0)), F.element_at(pages, -1)))


def dot(a, b) -> Column:
    """Dot product of two vectors, summed in double."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)")


def fold_change(ratio) -> Column:
    r = _c(ratio)
    return F.when(r <= 0, float("inf")).otherwise(F.greatest(r, 1 / r))


def excerpt(text, needle, width: int = 220) -> Column:
    """The surroundings of the first occurrence of needle, case aside; else the head."""
    t, half = _c(text), width // 2
    at = F.position(F.lower(_c(needle)), F.lower(t))
    low = F.greatest(at - 1 - half, F.lit(0))
    high = F.least(at - 1 + F.length(_c(needle)) + half, F.length(t))
    near = F.concat(F.when(low > 0, "…").otherwise(""), F.trim(F.substring(t, low + 1, high - low)), F.when(high < F.length(t), "…").otherwise(""))
    head = F.concat(F.trim(F.substring(t, 1, width)), F.when(F.length(t) > width, "…").otherwise(""))
    return F.when(at > 0, near).otherwise(head)


def flexible_blanks(pattern: str) -> str:
    """A pattern whose literal blanks match any white space, so phrases match across line breaks.

    Escapes and character classes stay as they are; one blank before a quantifier keeps its meaning."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        inside = (inside or c == "[") and not (inside and c == "]")
        if c != " " or inside:
            out.append(c)
            at += 1
            continue
        run = len(pattern[at:]) - len(pattern[at:].lstrip(" "))
        at += run
        out.append(r"\s" if run == 1 and pattern[at : at + 1] in ("?", "*", "+", "{") else r"\s+")
    return "".join(out)

"""Citation tokens resolved and quotes verified, in bulk: a join of tokens with documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.functions.columns import finding_id, page_of, span, span_hash, token_parts

GUARANTEES = {
    "native": "The quote stands in the document's own text at this place.",
    "ocr": "The quote stands in a machine reading of the page image; characters may be misread.",
    "vision": "The quote stands in a model's transcription of the page image, which can invent text; look at the page.",
}


def _folded(text):
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"(?U)\s+", " "))


def resolve(tokens: DataFrame, documents: DataFrame, context: int = 160, sources: DataFrame | None = None) -> DataFrame:
    """tokens(token, ...) with span, context, token_valid, source_confirmed, valid and provenance.

    documents(doc_id, text[, title, source_path, locator, text_provenance, pages]); sources(doc_id, text) are
    texts derived again from the source files: a missing one leaves a token valid, a differing one doesn't."""
    have = set(documents.columns)
    optional = {"title": "string", "source_path": "string", "locator": "string", "text_provenance": "string"}
    docs = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("doc_text"), *(F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in optional.items()), F.col("pages") if "pages" in have else F.lit(None).cast("array<struct<number:int,char_start:int,char_end:int,page_class:string,tier:string>>").alias("pages"))
    rows = tokens.withColumn("p", token_parts("token")).select("*", "p.doc_id", "p.start", "p.end", "p.hash").drop("p")
    rows = rows.join(docs, "doc_id", "left")
    rows = rows.withColumn("span", span("doc_text", "start", "end"))
    ok = F.coalesce(span_hash("start", "end", "span") == F.col("hash"), F.lit(False))
    rows = rows.withColumn("token_valid", ok)
    rows = rows.withColumn("context_before", F.substring("doc_text", F.greatest(F.col("start") - context, F.lit(0)) + 1, F.least(F.col("start"), F.lit(context))))
    rows = rows.withColumn("context_after", F.substring(F.col("doc_text"), F.col("end") + 1, F.lit(context)))
    if sources is not None:
        again = sources.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("source_text"))
        rows = rows.join(again, "doc_id", "left").withColumn("source_confirmed", F.when(F.col("source_text").isNotNull(), span("source_text", "start", "end") == F.col("span"))).drop("source_text")
    else:
        rows = rows.withColumn("source_confirmed", F.lit(None).cast("boolean"))
    rows = rows.withColumn("text_provenance", F.coalesce("text_provenance", F.lit("native")))
    page = page_of("pages", "start")
    rows = rows.withColumn("page_no", page["number"]).withColumn("page_tier", F.coalesce(page["tier"] if "pages" in have else F.lit(None), F.col("text_provenance")))
    rows = rows.withColumn("verification_scope", F.when(F.col("text_provenance") == "native", "source_text").otherwise("transcript"))
    review = (F.col("verification_scope") == "transcript") & ((F.col("text_provenance") == "vision") | (F.col("page_tier") == "vision"))
    rows = rows.withColumn("human_review_required", review)
    said = F.when(review, GUARANTEES["vision"]).when(F.col("verification_scope") == "transcript", GUARANTEES["ocr"]).otherwise(GUARANTEES["native"])
    rows = rows.withColumn("guarantee", said).withColumn("valid", F.col("token_valid") & F.coalesce(F.col("source_confirmed"), F.lit(True)))
    return rows.drop("doc_text", "pages", "hash")


def verify(claims: DataFrame, documents: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """claims(token, quote, ...) with quote_supported, verified, needs_pixel_review and caveat."""
    rows = resolve(claims, documents, sources=sources)
    quoted = _folded(F.col("quote"))
    supported = F.coalesce(F.col("token_valid") & (F.length("quote") > 0) & F.contains(_folded(F.col("span")), quoted), F.lit(False))
    rows = rows.withColumn("quote_supported", supported)
    rows = rows.withColumn("verified", supported & ~F.col("human_review_required") & F.coalesce(F.col("source_confirmed"), F.lit(True)))
    rows = rows.withColumn("needs_pixel_review", F.col("token_valid") & F.col("human_review_required"))
    return rows.withColumn("caveat", F.when(F.col("verified") & (F.col("verification_scope") == "transcript"), "machine_misread_possible"))


def finding_status(reviews: DataFrame | None, checked: DataFrame) -> DataFrame:
    """checked(finding_id, ...) with status: verified, unsupported, invalid_token, pending_review or rejected."""
    if reviews is not None:
        checked = checked.join(reviews.select("finding_id", "verdict"), "finding_id", "left")
    else:
        checked = checked.withColumn("verdict", F.lit(None).cast("string"))
    status = (F.when(~F.col("token_valid"), "invalid_token")
              .when(F.col("needs_pixel_review") & (F.col("verdict") == "confirmed"), F.when(F.col("quote_supported"), "verified").otherwise("unsupported"))
              .when(F.col("needs_pixel_review") & (F.col("verdict") == "rejected"), "rejected")
              .when(F.col("needs_pixel_review"), "pending_review")
              .when(F.col("verified"), "verified").otherwise("unsupported"))
    return checked.withColumn("status", status)


def audit(findings: DataFrame, documents: DataFrame, reviews: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """findings(claim, quote, token) verified again, all in one join: finding_id, status and what it rests on."""
    rows = findings.withColumn("finding_id", finding_id("claim", "token", "quote"))
    return finding_status(reviews, verify(rows, documents, sources))

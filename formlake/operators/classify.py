"""Document types from keywords, page shape and a cascade of rules; metadata and recommended fields by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.functions import fixed
from formlake.functions.text import NO_CASE, java


def classify_text(text: Column) -> Column:
    """struct(doc_type, confidence): the type with the highest share of its keywords, the first of equals; generic below its threshold."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scores = []
    for order, (kind, (words, least, _)) in enumerate(fixed.DOCUMENT_TYPES.items()):
        hits = sum((low.rlike(java(w)).cast("int") for w in words), F.lit(0))
        scores.append(F.struct((hits / F.lit(float(len(words)))).alias("confidence"), F.lit(-order).alias("order"), F.lit(kind).alias("doc_type"), F.lit(least).cast("double").alias("least")))
    best = F.array_max(F.array(*scores))
    kind = F.when(best["confidence"] >= best["least"], best["doc_type"]).otherwise("generic")
    return F.struct(kind.alias("doc_type"), best["confidence"].alias("confidence"))


def classify_shape(text: Column, width: Column, height: Column) -> Column:
    """As classify_text, made surer or less sure by the type's range of width / height; without a type, the shape of a card."""
    by_text = classify_text(text)
    aspect = width / height
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for kind, (_, _, span) in fixed.DOCUMENT_TYPES.items():
        if span:
            low = F.when(by_text["doc_type"] == kind, F.lit(span[0]).cast("double")).otherwise(low)
            high = F.when(by_text["doc_type"] == kind, F.lit(span[1]).cast("double")).otherwise(high)
    shaped = F.when(low.isNull(), by_text["confidence"]).when(aspect.between(low, high), F.least(F.lit(1.0), by_text["confidence"] * 1.2)).otherwise(by_text["confidence"] * 0.8)
    conf = F.when(by_text["doc_type"] == "generic", F.when(aspect.between(1.5, 1.7), F.lit(0.3)).otherwise(F.lit(0.0))).otherwise(shaped)
    return F.struct(by_text["doc_type"].alias("doc_type"), conf.cast("double").alias("confidence"))


def classify(text: Column, width: Column | None = None, height: Column | None = None) -> Column:
    return classify_text(text) if width is None or height is None else classify_shape(text, width, height)


def recommended_fields(kind: Column) -> Column:
    """Fields that documents of a type should have; none for other types."""
    out = None
    for k, names in fixed.RECOMMENDED.items():
        value = F.array(*[F.lit(n) for n in names])
        out = F.when(kind == k, value) if out is None else out.when(kind == k, value)
    return out.otherwise(F.array().cast("array<string>"))


def by_rules(text: Column, filename: Column | None = None) -> Column:
    """The first rule that applies: identity cards, passport, certificate, form, invoice, receipt, then the file's name."""
    low = F.lower(F.coalesce(text, F.lit("")))
    name = F.lower(F.coalesce(filename if filename is not None else F.lit(""), F.lit("")))
    is_id = low.rlike(java(fixed.ID_WORDS))
    return (
        F.when(is_id & (low.contains("aadhaar") | low.contains("aadhar")), "id_card")
        .when(is_id & (low.contains("driving") | low.contains("drl")), "driver_license").when(is_id, "id_card")
        .when(low.contains("passport"), "passport").when(low.rlike(java(fixed.CERTIFICATE_WORDS)), "certificate").when(low.rlike(java(fixed.FORM_WORDS)), "form")
        .when(low.rlike(java(r"invoice|bill\s+no")), "invoice").when(low.rlike("receipt|payment"), "receipt")
        .when(name.contains("passport"), "passport").when(name.contains("cert"), "certificate").when(name.contains("form"), "form").otherwise("unknown")
    )


def metadata(docs: DataFrame) -> DataFrame:
    """(doc_id, key, value) that documents (doc_id, text, doc_type by rules) hold for their type."""
    def found(pattern: str, flags: str = "(?dU)") -> Column:
        return F.nullif(F.regexp_extract("text", java(pattern, flags), 1), F.lit(""))

    kind = F.col("doc_type")
    entries = F.array(
        F.struct(F.lit("aadhaar_number").alias("key"), F.when(kind == "id_card", F.replace(found(r"(\d{4}\s?\d{4}\s?\d{4})"), F.lit(" "), F.lit(""))).alias("value")),
        F.struct(F.lit("pan_number").alias("key"), F.when(kind == "id_card", found(r"([A-Z]{5}\d{4}[A-Z])")).alias("value")),
        F.struct(F.lit("passport_number").alias("key"), F.when(kind == "passport", found(r"passport\s+no[.:]?\s*([A-Z0-9]+)", NO_CASE)).alias("value")),
        F.struct(F.lit("license_number").alias("key"), F.when(kind == "driver_license", found(r"(?:licen[cs]e|dl)\s+no[.:]?\s*([A-Z0-9]+)", NO_CASE)).alias("value")),
    )
    return docs.select("doc_id", F.inline(entries)).where(F.col("value").isNotNull())

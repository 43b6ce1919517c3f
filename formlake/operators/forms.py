"""Filling forms from extracted fields, confidence tiers, and the form's own checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.functions import fixed
from formlake.functions.text import strip


def form_map(spark: SparkSession) -> DataFrame:
    """(form_field, ord, synonym): which keys fill which form field, best first."""
    return spark.createDataFrame([(k, i, s) for k, own in fixed.FORM_FIELDS.items() for i, s in enumerate(own)], "form_field string, ord int, synonym string")


def form_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), r"[\s_-]", "_")


def tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.6, "medium").otherwise("low")


def fill(fields: DataFrame, mapping: DataFrame) -> DataFrame:
    """(doc_id, form_field, value, confidence, tier): for each form field the first synonym with a value."""
    have = fields.where(F.coalesce("value", F.lit("")) != "").withColumn("key", form_key(F.col("field")))
    names = mapping.withColumn("key", form_key(F.col("synonym")))  # 20 form fields, a few dozen rows
    met = have.join(F.broadcast(names), "key")
    best = met.groupBy("doc_id", "form_field").agg(F.min_by(F.struct("value", "confidence"), F.struct("ord", "field")).alias("b"))
    return best.select("doc_id", "form_field", "b.*").withColumn("tier", tier(F.col("confidence")))


def fill_wide(fields: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row a document with a column for each form field."""
    return fill(fields, mapping).groupBy("doc_id").pivot("form_field", list(fixed.FORM_FIELDS)).agg(F.first("value"))


def non_empty(fields: DataFrame) -> DataFrame:
    return fields.withColumn("value", strip(F.col("value"))).where("value <> ''")


def banner(fields: DataFrame) -> DataFrame:
    """Mean confidence per document as a percentage with one decimal."""
    return fields.groupBy("doc_id").agg(F.count("*").alias("n_fields"), F.round(F.avg("confidence") * 100, 1).alias("mean_percent"))


def accepted_upload(mime: Column, size: Column, limit: int = 50 * 1024 * 1024) -> Column:
    return mime.isin("application/pdf", "image/png", "image/jpeg", "image/jpg", "image/tiff", "image/bmp") & (size <= limit)

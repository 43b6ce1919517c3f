"""Confidence measures, rates and evaluation statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.functions.similarity import similarity
from formlake.functions.text import strip


def field_confidence(value: Column, ocr: Column, text_length: Column) -> Column:
    """0.7 of the recogniser's confidence and 0.3 of the text's length up to 20; 0 for blank values; between 0 and 1."""
    conf = ocr * 0.7 + F.least(F.lit(1.0), text_length / 20.0) * 0.3
    return F.when(F.coalesce(strip(value), F.lit("")) == "", F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), conf)))


def overall_confidence(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Weighted mean of confidence by weight per key: missing weights count 1 above but not below the line; the plain mean without any."""
    total = F.sum(F.col("confidence") * F.coalesce("weight", F.lit(1.0)))
    return rows.groupBy(key).agg(F.when(F.sum("weight").isNull() | (F.sum("weight") == 0), F.avg("confidence")).otherwise(total / F.sum("weight")).alias("overall"))


def rates(rows: DataFrame, key: str = "doc_id", match: float = 0.9, partial: float = 0.6) -> DataFrame:
    """Mean similarity and shares of match, partial and mismatch per key."""
    s = F.col("similarity")

    def share(c: Column) -> Column:
        return F.avg(F.when(c, 1.0).otherwise(0.0))

    return rows.groupBy(key).agg(
        F.avg(s).alias("mean_similarity"), share(s >= match).alias("match_rate"), share((s >= partial) & (s < match)).alias("partial_rate"), share(s < partial).alias("mismatch_rate"))


def engine_stats(results: DataFrame) -> DataFrame:
    """Per engine: total, success, errors, mean, least and greatest similarity. results: engine, error, similarity."""
    return results.groupBy("engine").agg(
        F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("success"), F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.avg("similarity").alias("avg_similarity"), F.min("similarity").alias("min_similarity"), F.max("similarity").alias("max_similarity"))


def status_counts(results: DataFrame) -> DataFrame:
    """Per document: numbers of each status and the mean similarity as a rounded percentage."""
    def n(s: str) -> Column:
        return F.count_if(F.col("status") == s).alias(s)

    return results.groupBy("doc_id").agg(n("match"), n("partial"), n("mismatch"), n("not_found"), F.round(F.avg("similarity") * 100).cast("long").alias("mean_percent"))


def source_counts(lines: DataFrame) -> DataFrame:
    """Lines by engine per document."""
    return lines.groupBy("doc_id", "ocr_source").agg(F.count("*").alias("n_lines"))


def word_confidence(words: Column) -> Column:
    """struct(text, confidence 0 to 1) of recognised words array<struct<text,conf>>: words of positive confidence that aren't blank."""
    good = F.filter(words, lambda w: (w["conf"].cast("int") > 0) & (strip(w["text"]) != ""))
    total = F.aggregate(good, F.lit(0.0).cast("double"), lambda a, w: a + w["conf"])
    mean = F.when(F.size(good) > 0, total / F.size(good) / 100).otherwise(F.lit(0.0))
    return F.struct(F.array_join(F.transform(good, lambda w: w["text"]), " ").alias("text"), mean.alias("confidence"))


def evaluate(samples: DataFrame, outputs: DataFrame) -> DataFrame:
    """outputs (sample_id, engine, text, error) with the similarity to the sample's ground truth, and whether it is 0.9 or more."""
    rows = outputs.join(samples.select("sample_id", "ground_truth"), "sample_id")
    rows = rows.withColumn("similarity", similarity(F.lit("gestalt"), "text", "ground_truth"))
    return rows.withColumn("match", F.col("similarity") >= 0.9)


def samples_by_engine(samples: DataFrame, engines: list[str], most: int = 100) -> DataFrame:
    """Each of the first `most` samples (by id) once for each engine; the limit is the evaluation's own setting."""
    few = samples.orderBy("sample_id").limit(most)
    return few.withColumn("engine", F.explode(F.array(*[F.lit(e) for e in engines])))

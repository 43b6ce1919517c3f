"""The same transformations over streams of texts and uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.operators.classify import classify_text
from formlake.operators.extract import extract_fields
from formlake.operators.verify import verify

FILES = "path string, modificationTime timestamp, length long, content binary"


def uploads(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).load(path)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of doc_id, text and arrival time."""
    return spark.readStream.schema("doc_id long, text string, at timestamp").json(path)


def stream_fields(docs: DataFrame) -> DataFrame:
    """Fields of each arriving document; works inside the row, so no state is kept."""
    return extract_fields(docs)


def stream_types(docs: DataFrame) -> DataFrame:
    kind = classify_text(F.col("text"))
    return docs.select("doc_id", "at", kind["doc_type"].alias("doc_type"), kind["confidence"].alias("confidence"))


def type_counts(docs: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Documents by type in tumbling windows; windows close `late` behind the latest arrival."""
    return stream_types(docs).withWatermark("at", late).groupBy(F.window("at", width), "doc_type").agg(F.count("*").alias("n"))


def submissions_with_fields(submitted: DataFrame, extracted: DataFrame, wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Each submission beside the fields of its document, from two streams: request_id, doc_id, at, asked, have.

    submitted: request_id, doc_id, at, asked (map field -> value). extracted: doc_id, found_at, have (map field -> value). A submission waits
    for an extraction from `wait` before it to `wait` after it; state older than that goes with the watermarks, `late` behind the latest
    times seen, and a submission that has met none by then comes out with have null. Several extractions of a document in that time give a
    row each. Rows later than their watermark are left out, as Spark does."""
    s = submitted.withWatermark("at", late).select("request_id", "doc_id", "at", "asked")
    e = extracted.withWatermark("found_at", late).select(F.col("doc_id").alias("of"), "found_at", "have")
    near = (F.col("found_at") >= F.col("at") - F.expr(f"interval {wait}")) & (F.col("found_at") <= F.col("at") + F.expr(f"interval {wait}"))
    return s.join(e, (F.col("doc_id") == F.col("of")) & near, "left_outer").drop("of")


def verified(joined: DataFrame) -> DataFrame:
    """request_id, doc_id, found_at, and verify's columns of a batch of joined submissions; what met no extraction is not_found, with null in found_at."""
    # one submission meets one extraction at a time
    rows = joined.select(F.struct("request_id", "doc_id", "found_at").alias("pair"), "asked", "have")
    asked = rows.select(F.col("pair").alias("doc_id"), F.explode("asked").alias("field", "submitted"))
    have = rows.select(F.col("pair").alias("doc_id"), F.explode("have").alias("field", "value"))
    found = verify(asked, have)
    return found.select("doc_id.request_id", "doc_id.doc_id", "doc_id.found_at", *[c for c in found.columns if c != "doc_id"])


def verify_stream(submitted: DataFrame, extracted: DataFrame, path: str, checkpoint: str, **options):
    """Starts a query that writes verified submissions as parquet below path, a folder for each batch, so that a batch done again replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        verified(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    joined = submissions_with_fields(submitted, extracted, **options)
    return joined.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()

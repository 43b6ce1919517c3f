"""Pluggable recognition: engines are functions from page images to text and confidence, run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.operators.route import longer, needs_retry

#: Makes the engine once in each worker process; the engine gives (text, confidence) of one image row.
EngineMaker = Callable[[], Callable[[dict], tuple[str, float]]]


def recognise(pages: DataFrame, maker: EngineMaker, engine: str) -> DataFrame:
    """pages (doc_id, page_idx, image) with text, confidence and error; a failing page has empty text and its error, not a failed task."""

    @F.pandas_udf("struct<text:string,confidence:double,error:string>")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = maker()
        for b in batches:
            rows = []
            for image in b.to_dict("records"):
                try:
                    rows.append((*own(image), None))
                except Exception as e:  # noqa: BLE001  one bad page must not stop the others
                    rows.append(("", 0.0, str(e)))
            yield pd.DataFrame(rows, columns=["text", "confidence", "error"])

    found = pages.withColumn("r", run("image"))
    return found.select(*pages.columns, F.lit(engine).alias("engine"), "r.text", "r.confidence", "r.error")


def with_retry(first: DataFrame, pages: DataFrame, maker: EngineMaker, mode: str = "auto", least: int = 40) -> DataFrame:
    """Short results are read again by the hand-writing engine, and its text kept if longer; only those pages go through it."""
    short = first.where(needs_retry(F.col("text"), F.col("engine"), mode, least)).select("doc_id", "page_idx")
    again = recognise(pages.join(short, ["doc_id", "page_idx"]), maker, "handwritten").select("doc_id", "page_idx", F.col("text").alias("text2"), F.col("confidence").alias("confidence2"))
    both = first.join(again, ["doc_id", "page_idx"], "left")
    better = longer(F.col("text"), F.col("text2"))
    return both.select(
        *[c for c in first.columns if c not in ("text", "confidence", "engine")],
        F.when(better, F.col("text2")).otherwise(F.col("text")).alias("text"), F.when(better, F.col("confidence2")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(better, F.lit("handwritten")).otherwise(F.col("engine")).alias("engine"))

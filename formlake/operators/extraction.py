"""From page images to texts and fields: the whole extraction, as one chain of DataFrame steps.

pages: doc_id, page_idx, image (Spark's image struct). Engines are plug-ins (see `ocr`); each runs on the pages that need it only.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.operators import extract, ocr, raster, route
from formlake.sources.store import Store

LINES = "array<struct<y1:int,y2:int>>"


def with_kind(pages: DataFrame) -> DataFrame:
    """pages with text_kind: printed, mixed, handwritten or unknown."""
    measured = pages.withColumn("gaps", raster.gap_measures(F.col("image"))).withColumn("m", raster.measures(F.col("image")))
    kind = route.text_kind(F.col("gaps.line_gap"), F.col("gaps.char_gap"), F.col("m.edges"), F.col("gaps.has_lines"))
    return measured.withColumn("text_kind", kind).drop("gaps", "m")


def _found_lines(image: pd.DataFrame) -> pd.Series:
    rows = zip(image["height"], image["width"], image["nChannels"], image["data"], strict=True)
    return pd.Series([[{"y1": a, "y2": b} for a, b in raster.text_lines(raster.pixels(h, w, c, data))] for h, w, c, data in rows])


def _cropped(image: pd.DataFrame, y1: pd.Series, y2: pd.Series) -> pd.DataFrame:
    rows = []
    for o, h, w, c, mode, data, a, b in zip(*(image[k] for k in ("origin", "height", "width", "nChannels", "mode", "data")), y1, y2, strict=True):
        part = np.ascontiguousarray(raster.pixels(h, w, c, data)[max(0, a) : min(h, b)])
        rows.append((o, part.shape[0], w, c, mode, part.tobytes()))
    return pd.DataFrame(rows, columns=["origin", "height", "width", "nChannels", "mode", "data"])


def lines_of(pages: DataFrame, margin: int = 5) -> DataFrame:
    """(doc_id, page_idx, y1, y2, image): each text line of each page cut out, with a margin."""
    found = pages.withColumn("line", F.explode(F.pandas_udf(_found_lines, LINES)("image")))
    cut = F.pandas_udf(_cropped, raster.IMAGE)("image", F.col("line.y1") - margin, F.col("line.y2") + margin)
    return found.select("doc_id", "page_idx", "line.y1", "line.y2", cut.alias("image"))


def handwritten_pages(pages: DataFrame, maker: ocr.EngineMaker, engine: str = "handwritten") -> DataFrame:
    """(doc_id, page_idx, text, confidence, lines) of pages read line by line; lines without text stay in `lines` only."""
    read = ocr.recognise(lines_of(pages), maker, engine)
    line = F.struct("y1", "y2", "text", "confidence", "engine")
    both = read.groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.avg("confidence").alias("confidence"))
    texts = F.filter(F.transform("lines", lambda x: x["text"]), lambda t: F.trim(t) != "")
    return both.select("doc_id", "page_idx", F.array_join(texts, "\n").alias("text"), "confidence", "lines")


def page_texts(pages: DataFrame, printed: ocr.EngineMaker, handwritten: ocr.EngineMaker | None = None, mode: str = "auto", engine: str = "printed") -> DataFrame:
    """(doc_id, page_idx, text, confidence, engine, error) of each page; short results are read again as handwriting (mode auto)."""
    slim = pages.select("doc_id", "page_idx", "image")
    first = ocr.recognise(slim, printed, engine).drop("image")
    return first if handwritten is None else ocr.with_retry(first, slim, handwritten, mode)


def routed_texts(pages: DataFrame, engines: Mapping[str, ocr.EngineMaker], mode: str = "auto", least: int = 40) -> DataFrame:
    """(doc_id, page_idx, text, confidence, engine, error) of pages (doc_id, page_idx, image, text_kind, language): each is read by the engine for its kind.

    engines: makers by name (printed, handwritten, tesseract). An engine that isn't there is stood in for by the next that is: tesseract for the two models,
    then printed, then handwritten. A null language is English, a null kind unknown. Handwriting reads a page again as `mode` has it."""
    if not engines:
        raise ValueError("no engine")
    wanted = route.choose_engine(F.coalesce("language", F.lit("eng")), F.coalesce("text_kind", F.lit("unknown")), None, "handwritten" in engines, "printed" in engines)
    spare = next(e for e in ("tesseract", "printed", "handwritten") if e in engines)
    dealt = pages.withColumn("engine", F.when(wanted.isin(*engines), wanted).otherwise(spare)).select("doc_id", "page_idx", "image", "engine")
    read = None
    for name, maker in engines.items():
        one = ocr.recognise(dealt.where(F.col("engine") == name).drop("engine"), maker, name).drop("image")
        read = one if read is None else read.unionByName(one)
    return ocr.with_retry(read, dealt.drop("engine"), engines["handwritten"], mode, least) if "handwritten" in engines else read


PAGE_STATE = "doc_id long, page_idx long, text string, confidence double, engine string, error string, tries int"


def page_states(pages: DataFrame, path: str, engines: Mapping[str, ocr.EngineMaker], mode: str = "auto", most: int = 3, parts: int = 64) -> Store:
    """Reads those pages that have no text in the store at `path` yet, and adds their states; a run after a failure goes on where the one before ended.

    pages: as for `routed_texts`. A page is done once it was read without an error, or tried `most` times. The state of a page
    (doc_id, page_idx): PAGE_STATE. Pages of a run whose write was not finished are read again. Pages that share a key are one, the least image counts."""
    store = Store(pages.sparkSession, path, PAGE_STATE, ["doc_id", "page_idx"], parts)
    one = pages.groupBy("doc_id", "page_idx").agg(F.min(F.struct("text_kind", "language", "image")).alias("p")).select("doc_id", "page_idx", "p.*")
    before = store.latest().select(F.col("doc_id").alias("d"), F.col("page_idx").alias("i"), "tries", (F.col("error").isNull() | (F.col("tries") >= most)).alias("done"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("page_idx").eqNullSafe(F.col("i"))
    open_ = one.join(before.where("done"), same, "left_anti")
    read = routed_texts(open_, engines, mode)
    tried = read.join(before.where("not done").select("d", "i", "tries"), same, "left").drop("d", "i")
    store.append(tried.withColumn("tries", F.coalesce("tries", F.lit(0)) + 1))
    return store


def documents_of(states: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """One row a document from page states, as `extract_documents` has it."""
    about = states.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), F.avg("confidence").alias("confidence"), F.array_sort(F.collect_set("engine")).alias("engines"), F.array_compact(F.collect_list("error")).alias("errors"))
    texts = extract.join_pages(states.select("doc_id", "page_idx", "text"))
    maps = extract.as_maps(extract.map_fields(texts, aliases))
    return about.join(texts, "doc_id", "left").join(maps, "doc_id", "left")


def extract_documents(pages: DataFrame, printed: ocr.EngineMaker, handwritten: ocr.EngineMaker | None = None, mode: str = "auto", aliases: DataFrame | None = None) -> DataFrame:
    """One row a document: doc_id, text, fields, confidences, n_pages, confidence (mean over pages), engines, errors."""
    return documents_of(page_texts(pages, printed, handwritten, mode), aliases)

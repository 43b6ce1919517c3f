"""Recognition engines: languages, choice of engine, the hand-writing retry, and scores of text kinds."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.functions import fixed
from formlake.functions.text import strip


def recogniser_language(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(fixed.LANGUAGES.items())])
    return F.coalesce(F.try_element_at(table, F.lower(code)), F.lit("eng"))


def choose_engine(language: Column, text_type: Column, force: Column | None = None, has_handwriting: bool = True, has_printed: bool = True) -> Column:
    """handwritten, printed or tesseract. Other languages than "eng" go to tesseract; printed text asks the printed model first."""
    first_printed = "printed" if has_printed else "handwritten" if has_handwriting else "tesseract"
    first_written = "handwritten" if has_handwriting else "printed" if has_printed else "tesseract"
    out = F.when(language != "eng", "tesseract").when(text_type == "printed", first_printed).otherwise(first_written)
    return out if force is None else F.coalesce(force, out)


def engine_confidence(engine: Column, tesseract: Column) -> Column:
    return F.when(engine == "printed", F.lit(0.85)).when(engine == "handwritten", F.lit(0.80)).otherwise(tesseract)


def needs_retry(text: Column, engine: Column, mode: str = "auto", least: int = 40) -> Column:
    """Whether the hand-writing engine reads a page too: never ("off"), for short text ("auto"), or on every page that it hasn't read yet ("always")."""
    if mode == "off":
        return F.lit(False)
    if mode == "always":
        return engine != "handwritten"
    return (F.length(strip(F.coalesce(text, F.lit("")))) < least) & (engine != "handwritten")


def longer(first: Column, second: Column) -> Column:
    """Whether the second text is strictly longer, blanks around aside; null is as short as none."""
    return F.length(strip(F.coalesce(second, F.lit("")))) > F.length(strip(F.coalesce(first, F.lit(""))))


def keep_longer(first: Column, second: Column) -> Column:
    """The second text only if it is strictly longer."""
    return F.when(longer(first, second), second).otherwise(first)


def text_kind(line_gap_std: Column, char_gap_std: Column, edge_density: Column, has_lines: Column) -> Column:
    """printed, mixed, handwritten or unknown, from the spread of gaps and the share of edges."""
    score = F.when(line_gap_std < 5, 0.3).when(line_gap_std < 10, 0.15).otherwise(0.0)
    score = score + F.when(char_gap_std < 3, 0.3).when(char_gap_std < 6, 0.15).otherwise(0.0)
    score = score + F.when(edge_density > 0.1, 0.2).when(edge_density > 0.05, 0.1).otherwise(0.0)
    return F.when(~has_lines, "unknown").when(score >= 0.7, "printed").when(score >= 0.35, "mixed").when(score > 0, "handwritten").otherwise("unknown")


def line_runs(projection: DataFrame, enter: float = 50, leave: float = 50, least: int = 12) -> DataFrame:
    """(doc_id, y1, y2) of text lines in a row projection (doc_id, y, ink): runs of ink over `enter` that end before the last row.

    Runs higher than `least` count; a run that reaches the bottom edge is never closed."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("y")
    rows = projection.withColumn("on", F.when(F.col("ink") > enter, 1).when(F.col("ink") < leave, 0))
    rows = rows.withColumn("on", F.coalesce("on", F.last("on", ignorenulls=True).over(w), F.lit(0)))
    rows = rows.withColumn("turn", F.when(F.col("on") != F.coalesce(F.lag("on").over(w), F.lit(0)), 1).otherwise(0)).withColumn("run", F.sum("turn").over(w))
    runs = rows.where("on = 1").groupBy("doc_id", "run").agg(F.min("y").alias("y1"), (F.max("y") + 1).alias("y2"))
    last = projection.groupBy("doc_id").agg(F.max("y").alias("bottom"))
    return runs.join(last, "doc_id").where((F.col("y2") <= F.col("bottom")) & (F.col("y2") - F.col("y1") > least)).select("doc_id", "y1", "y2")


def cells_in_order(cells: Column) -> Column:
    """Cells array<struct<x,y,w,h,...>> by row, then column."""
    return F.transform(F.array_sort(F.transform(cells, lambda c: F.struct(c["y"].alias("y"), c["x"].alias("x"), c.alias("c")))), lambda s: s["c"])

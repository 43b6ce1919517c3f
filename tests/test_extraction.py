"""Pages to texts and fields, line crops, gap measures, matcher shortcuts, and import cycles of any length."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from formlake.functions import similarity as sim
from formlake.operators import extract, extraction, graph, raster, templates
from formlake.sources import files


def page(rows, width=120, height=100):
    """A white page with dark bars at the given rows (y, x1, x2), each 16 rows high."""
    img = np.full((height, width, 1), 250, dtype=np.uint8)
    for y, a, b in rows:
        img[y : y + 16, a:b] = 10
    return ("mem", height, width, 1, 0, img.tobytes())


def pages(spark, rows):
    return spark.createDataFrame(rows, f"doc_id long, page_idx int, image {raster.IMAGE}")


def readers():
    """Engine makers, made here so that they travel by value: one tells how many dark columns a page has, one reads a long text."""

    def width_reader():
        def read(image):
            img = np.frombuffer(image["data"], dtype=np.uint8).reshape(image["height"], image["width"])
            return f"Name: W{int((img < 100).any(axis=0).sum())}", 0.5

        return read

    def long_reader():
        return lambda image: ("City: Rome\nName: a hand-written page of some length, over forty letters", 0.9)

    return width_reader, long_reader


def test_lines_are_cut_out_and_joined_in_order(spark):
    df = pages(spark, [(1, 0, page([(20, 10, 80), (60, 10, 40)])), (2, 0, page([]))])
    lines = extraction.lines_of(df).orderBy("y1").collect()
    assert len(lines) == 2 and all(r["doc_id"] == 1 and r["image"]["width"] == 120 for r in lines)
    got = extraction.handwritten_pages(df, readers()[0]).collect()
    assert [r["text"] for r in got] == ["Name: W70\nName: W30"]


def test_text_lines_count_any_ink():
    img = np.full((80, 200, 1), 250, dtype=np.uint8)
    img[30:50, 100:102] = 0  # two columns of ink make a line
    assert len(raster.text_lines(img)) == 1


def test_gaps_against_brute_force():
    r = np.random.default_rng(4)
    g = np.where(r.random((60, 90)) < 0.9, 20.0, 240.0)
    ink = raster.binarise(g) == 0

    def runs(on, n):
        return [i for i, row in enumerate(on) if any(row[k : k + n].all() for k in range(len(row) - n + 1))]

    rows, cols = runs(ink, 40), runs(ink.T, 5)
    want = tuple(float(np.diff(x).std()) if len(x) > 1 else 0.0 for x in (rows, cols))
    assert raster.gaps(g) == (*want, len(rows) > 0)
    assert raster.gaps(np.full((10, 10), 250.0))[2] is False


def test_documents_from_pages(spark):
    df = pages(spark, [(1, 1, page([(20, 10, 80)])), (1, 0, page([(20, 10, 40)])), (2, 0, page([]))])
    got = {r["doc_id"]: r for r in extraction.extract_documents(df, *readers()).collect()}
    assert got[1]["n_pages"] == 2 and got[1]["engines"] == ["handwritten"] and got[1]["fields"]["city"] == "Rome"
    plain = {r["doc_id"]: r for r in extraction.extract_documents(df, readers()[0], mode="off").collect()}
    assert plain[1]["text"] == "Name: W30\n\nName: W70" and plain[1]["confidence"] == 0.5 and plain[2]["errors"] == []


def test_matcher_shortcuts(spark):
    docs = spark.createDataFrame([(1, "Name: Ann Lee\nCity: Rome"), (2, None), (3, "")], "doc_id long, text string")
    full = extract.match_lines(docs).select("doc_id", "field", "value").collect()
    assert {(r[0], r[1]) for r in full} == {tuple(r) for r in extract.matched_fields(docs).collect()} and full
    assert extract.partial_fields(docs).collect()[0]["fields"] == {r["field"]: r["value"] for r in full}
    assert extract.partial_fields(docs, []).count() == 0
    assert extract.pair_values(docs).collect()[0]["fields"] == {r["field"]: r["value"] for r in full}
    odd = spark.createDataFrame([(1, "Cıty: Rome"), (2, "CİTY: Rome")], "doc_id long, text string")
    assert {(r["doc_id"], r["value"]) for r in extract.extract_fields(odd).where("field = 'city'").collect()} == {(1, "Rome"), (2, "Rome")}


def test_numbers_of_separators_only_are_equal():
    assert sim.number_score("-", "( )") == 1.0 and sim.number_score("", "-") == 0.0


def test_cycles_of_any_length(spark):
    ring = spark.createDataFrame([(f"m{i}", f"m{(i + 1) % 9}") for i in range(9)], "src string, dst string")
    assert [r["cycle"] for r in graph.cycles(ring).collect()] == [[f"m{i}" for i in range(9)]]
    assert graph.cycles(ring, 6).count() == 0


def test_unreadable_images_and_missing_templates(spark, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"no image")
    good, bad = files.readable(files.images(spark, str(tmp_path)))
    assert good.count() == 0 and [r["reason"] for r in bad.collect()] == ["not an image"]
    own = templates.latest(spark.createDataFrame([], templates.SCHEMA))
    assert templates.load(own, str(tmp_path / "none")).count() == 0


def test_issues_of_an_image(spark):
    m = F.struct(F.lit(10.0).alias("blur"), F.lit(30.0).alias("noise"), F.lit(40.0).alias("brightness"))
    got = spark.range(1).select(raster.issues(m).alias("i"), raster.suggest_retake(m).alias("r")).first()
    assert got["i"] == ["blur", "noise", "dark"] and got["r"]
    assert isinstance(raster.gap_measure(pd.DataFrame([page([])], columns=["origin", "height", "width", "nChannels", "mode", "data"])), pd.DataFrame)

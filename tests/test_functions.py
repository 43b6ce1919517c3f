"""Similarity, validation and raster functions on small hand-checked cases."""

from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from formlake.functions import similarity as sim
from formlake.functions import text, validate
from formlake.operators import graph, raster, route, verify
from formlake.sources import files

words = st.text(alphabet="ab c", max_size=12)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_ratio_is_symmetric_and_bounded(a, b):
    assert sim.ratio(a, b) == sim.ratio(b, a)
    assert 0 <= sim.ratio(a, b) <= 100
    assert sim.ratio(a, a) == 100
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert sim.common(a, b) == table[-1][-1]


def test_known_scores():
    assert sim.name_score("Rao Asha", "asha rao") == 1.0
    assert sim.number_score("98765-43210", "9876543210") == 1.0
    assert sim.number_score("9876543210", "987654321") == pytest.approx(18 / 19)
    assert sim.address_score("12 Main Road", "Main Road 12 North") == 1.0
    assert sim.name_score("", "x") == 0.0


def test_dates(spark):
    given_ = ["3/4/1990", "03-04-1990", "1990-04-03", "3/4/75", "3/4/20", "31/02/2020", "3.4.1990", "", None]
    want = []
    for s in given_:
        out = None
        for f in ("%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%d", "%d/%m/%y", "%d-%m-%y"):
            try:
                out = out or (datetime.strptime(s.strip(), f).strftime("%Y-%m-%d") if s else None)
            except ValueError:
                pass
        want.append(out)
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(given_)], "i int, s string")
    assert [r[0] for r in rows.orderBy("i").select(validate.iso_date(F.col("s"))).collect()] == want


def test_text_helpers(spark):
    row = spark.range(1).select(
        text.normal_key(F.lit("_Date of  Birth!")).alias("k"), text.title(F.lit("full_name x")).alias("t"), text.file_size(F.lit(1536)).alias("s"),
        text.split_lines(F.lit("a\r\nb\u2028c\n")).alias("l"), text.file_size(F.lit(0)).alias("z")).first()
    assert tuple(row) == ("date_of_birth", "Full Name X", "1.5 KB", ["a", "b", "c"], "0 Bytes")


def test_three_tiers_of_keys(spark):
    sent = spark.createDataFrame([(1, "email", "a"), (1, "EMAIL", "a"), (1, "e_mail", "a"), (1, "zzz", "a")], "doc_id int, field string, submitted string")
    have = spark.createDataFrame([(1, "email", "a")], "doc_id int, field string, value string")
    got = {r["field"]: (r["tier"], r["extracted"]) for r in verify.resolve_keys(sent, have).collect()}
    assert got == {"email": (1, "a"), "EMAIL": (2, "a"), "e_mail": (3, "a"), "zzz": (None, None)}
    states = {r["field"]: r["status"] for r in verify.verify(sent, have).collect()}
    assert states == {"email": "match", "EMAIL": "match", "e_mail": "match", "zzz": "not_found"}


def test_measures_of_plain_images(spark):
    flat = np.full((20, 20, 3), 100, dtype=np.uint8)
    board = np.where(np.indices((20, 20)).sum(axis=0)[:, :, None] % 2 == 0, 0, 255).repeat(3, axis=2).astype(np.uint8)
    rows = [(1, ("a", 20, 20, 3, 16, flat.tobytes())), (2, ("b", 20, 20, 3, 16, board.tobytes()))]
    df = spark.createDataFrame(rows, f"id int, image {raster.IMAGE}")
    got = df.select("id", raster.measures(F.col("image")).alias("m")).select("id", "m.*", raster.quality(F.col("m")).alias("q")).orderBy("id").collect()
    assert (got[0]["blur"], got[0]["noise"], got[0]["brightness"], got[0]["motion"]) == (0, 0, 100, 0)
    assert got[0]["q"]["label"] == "ok" and got[0]["q"]["is_blurry"] and not got[1]["q"]["is_blurry"]
    small = raster.pixel_operation(raster.prepare(max_dim=10, border=1))
    assert df.select(small("image").alias("o")).select("o.height").first()[0] == 8


def test_text_lines():
    img = np.full((100, 100, 1), 255, dtype=np.uint8)
    img[20:40, 5:95:2] = 0
    img[80:100, 5:95:2] = 0
    lines = raster.text_lines(img)
    assert len(lines) == 1 and abs(lines[0][0] - 20) <= 2


def test_routes_and_kinds(spark):
    rows = spark.createDataFrame([("eng", "printed"), ("en", "printed"), ("eng", "mixed")], "l string, t string")
    assert [r[0] for r in rows.select(route.choose_engine(F.col("l"), F.col("t"))).collect()] == ["printed", "tesseract", "handwritten"]
    heads = spark.createDataFrame([(bytearray(b"%PDF-1"), "x.png"), (bytearray(b"\x89PNG"), "x.jpg"), (bytearray(b"zz"), "x.gif"), (bytearray(b"zz"), "x")], "c binary, n string")
    assert [r[0] for r in heads.select(files.file_kind(F.col("c"), F.col("n"))).collect()] == ["pdf", "png", "image", None]


def test_import_graph(spark):
    src = spark.createDataFrame([("/r/app/a.py", "import app.b\nfrom app.c import x"), ("/r/app/b.py", "from app.a import y"), ("/r/app/c.py", "import app.c")], "path string, value string")
    e = graph.scan_imports(src, "app")
    assert {tuple(r) for r in e.collect()} == {("app.a", "app.b"), ("app.a", "app.c"), ("app.b", "app.a"), ("app.c", "app.c")}
    assert [r["cycle"] for r in graph.cycles(e).collect()] == [["app.a", "app.b"]]


def brute_components(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: set() for n in nodes}
    for n in nodes:
        todo = [n]
        while todo:
            for a, b in edges:
                if a == todo[-1] and b not in reach[n]:
                    reach[n].add(b)
                    todo.insert(0, b)
            todo.pop()
    groups = {n: {m for m in nodes if m in reach[n] and n in reach[m]} | {n} for n in nodes}
    return {(n, min(g)) for n, g in groups.items() if len(g) > 1}


def test_strongly_connected_components(spark):
    import random

    from formlake.operators import graph

    r = random.Random(6)
    for n, m in ((14, 22), (10, 0), (12, 40)):
        edges = sorted({(f"m{r.randrange(n):02}", f"m{r.randrange(n):02}") for _ in range(m)} | {("z", "z"), ("y1", "y2")})
        df = spark.createDataFrame([*edges, *edges[:3]], "src string, dst string")
        assert {tuple(x) for x in graph.components(df).collect()} == brute_components(edges)
    ring = spark.createDataFrame([(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)], "src string, dst string")
    assert [x["cycle"] for x in graph.cycles(ring).collect()] == [[f"r{i}" for i in range(9)]]


def test_components_are_found_in_slices(spark):
    import random

    from formlake.operators import graph

    r = random.Random(9)
    for n, m, most in ((30, 40, 5), (40, 55, 9), (12, 60, 3)):
        edges = sorted({(f"m{a:02}", f"m{(a + r.choice([1, 2, -1, 0, 5])) % n:02}") for a in (r.randrange(n) for _ in range(m))} | {("m00", f"m{k:02}") for k in range(1, 12)})
        df = spark.createDataFrame(edges, "src string, dst string")
        assert {tuple(x) for x in graph.components(df, most).collect()} == brute_components(edges), (n, m, most)
    # a thousand loops of neighbours: a few jobs, not some for every step along a loop
    loops = spark.createDataFrame([(f"n{k:05}", f"n{k - k % 9 + (k + 1) % 9:05}") for k in range(9000)], "src string, dst string")
    spark.sparkContext.setJobGroup("loops", "")
    assert graph.components(loops).count() == 9000
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("loops")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 20


def test_import_scan_deals_its_sources(spark):
    from formlake.plans import catalogue

    plan = catalogue.queries()["import_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "RepartitionByExpression" in plan

"""Runs, touching boxes, regions and ruled tables against plain loops."""

import random

import numpy as np

from formlake.operators import graph, layout, raster

BOX = "doc_id long, x1 long, y1 long, x2 long, y2 long"


def grouped(boxes):
    """Bounding boxes of connected boxes, by merging until nothing changes."""
    groups = [[b] for b in boxes]
    meet = lambda p, q: p[0] == q[0] and p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]
    at = 0
    while at < len(groups):
        other = next((k for k in range(at + 1, len(groups)) if any(meet(p, q) for p in groups[at] for q in groups[k])), None)
        if other is None:
            at += 1
        else:
            groups[at] += groups.pop(other)
            at = 0
    return sorted((g[0][0] is not None, g[0][0] or 0, min(b[1] for b in g), min(b[2] for b in g), max(b[3] for b in g), max(b[4] for b in g), len(g)) for g in groups)


def plain(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["x1"], r["y1"], r["x2"], r["y2"], r["n"]) for r in df.collect())


def test_connected_against_loops(spark):
    r = random.Random(3)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)]
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        todo = [] if n in want else [n]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    got = graph.connected(spark.createDataFrame(links, "a int, b int")).collect()
    assert len(got) == len(want) and {x["node"]: x["root"] for x in got} == want
    assert graph.connected(spark.createDataFrame([(1, 1)], "a int, b int")).count() == 0


def test_regions_against_loops(spark):
    r = random.Random(5)
    boxes = []
    for doc in (1, 2, None):
        for _ in range(60):
            x, y = r.randrange(-50, 300), r.randrange(-50, 300)
            boxes.append((doc, x, y, x + r.choice((1, 5, 20, 90)), y + r.choice((1, 5, 20, 90))))
    boxes += boxes[:3] + [(4, 0, 0, 1, 1), (4, 1, 1, 2, 2), (4, 3, 0, 4, 1)]
    df = spark.createDataFrame(boxes, BOX)
    for grid in (16, 64):
        assert plain(layout.regions(df, grid)) == grouped(boxes)
    holes = spark.createDataFrame([(1, None, 0, 1, 1)], BOX)
    assert layout.regions(holes).count() == 0 and layout.regions(df.where("false")).count() == 0


def test_text_runs(spark):
    docs = spark.createDataFrame([(1, "ab  c d\n\n é😀x"), (1, "ab  c d\n\n é😀x"), (2, None), (3, ""), (4, "   ")], "doc_id long, text string")
    got = sorted(tuple(x) for x in layout.text_runs(docs).distinct().select("y1", "x1", "x2").collect())
    assert got == [(0, 0, 2), (0, 4, 5), (0, 6, 7), (2, 1, 4)]
    assert layout.text_runs(docs).count() == 8
    ends = spark.createDataFrame([(1, " ab c  d ")], "doc_id long, text string")
    assert sorted(tuple(x) for x in layout.text_runs(ends, gap=1).select("x1", "x2").collect()) == [(1, 5), (7, 8)]
    wide = sorted(tuple(x) for x in layout.text_runs(docs, gap=1).distinct().select("y1", "x1", "x2").collect())
    assert wide == [(0, 0, 2), (0, 4, 7), (2, 1, 4)]


def test_regions_of_few_and_many_boxes_agree(spark):
    r = random.Random(11)
    boxes = [(d or None, x, y, x + r.randrange(1, 30), y + r.randrange(1, 30)) for d in range(40) for _ in range(1 + d) for x, y in [(r.randrange(200), r.randrange(200))]]
    df = spark.createDataFrame([*boxes, boxes[5]], BOX)
    want = grouped([*boxes, boxes[5]])
    for few in (0, 12, 256):
        assert plain(layout.regions(df, 64, few)) == want
    chain = spark.createDataFrame([(d, 3 * k, 0, 3 * k + 3, 2) for d in range(50) for k in range(100)], BOX)  # a path of a hundred boxes takes no rounds of joins
    spark.sparkContext.setJobGroup("chain", "")
    assert {x[1:] for x in plain(layout.regions(chain))} == {(d, 0, 0, 300, 2, 100) for d in range(50)}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chain")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 10


def test_text_regions_are_those_of_the_runs(spark):
    r = random.Random(8)
    rows = [(k, "\n".join("".join(r.choice("ab  ") for _ in range(r.randrange(30))) for _ in range(r.randrange(25)))) for k in range(20)] + [(30, None), (31, ""), (32, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for gap in (0, 1):
        want = plain(layout.regions(layout.text_runs(docs, gap=gap), 16))
        assert plain(layout.text_regions(docs, gap=gap)) == want and len(want) > 50
    assert "Exchange" not in layout.text_regions(docs)._jdf.queryExecution().toString()


def drawn(height=300, width=400):
    """A ruled table of three columns and two rows, one of which holds text, and a short bar elsewhere."""
    img = np.full((height, width, 1), 250, dtype=np.uint8)
    for y in (40, 100, 160):
        img[y : y + 2, 50:251] = 0
    for x in (50, 110, 180, 249):
        img[40:162, x : x + 2] = 0
    img[60:70, 60:75] = 0
    img[220, 20:30] = 0
    return ("mem", height, width, 1, 0, img.tobytes())


def test_tables_and_cells_of_an_image(spark):
    images = spark.createDataFrame([(1, drawn()), (2, ("mem", 80, 80, 1, 0, bytes([250]) * 6400))], f"doc_id long, image {raster.IMAGE}")
    runs, pages = raster.ink_runs(images), images.select("doc_id", "image.width", "image.height")
    found = layout.tables(runs, pages)
    assert [tuple(x) for x in found.collect()] == [(1, 0, 49, 39, 252, 163)]
    cells = layout.table_cells(layout.ruled(runs, pages), found).collect()[0]["cells"]
    assert [tuple(c) for c in cells] == [(52, 42, 58, 58), (112, 42, 68, 58), (182, 42, 67, 58), (52, 102, 58, 58), (112, 102, 68, 58), (182, 102, 67, 58)]

"""Layout of pages as rows: runs of ink, boxes that touch, regions they make, and tables enclosed by ruled lines.

A box is (doc_id, x1, y1, x2, y2) in whole numbers, x2 and y2 past its end; two boxes touch if their closed areas share a point, so
runs of neighbouring rows touch along edges and at corners. A page of few boxes is solved in its row; the boxes of other pages are dealt over the cells of a grid and meet there, so one page with very many
boxes is spread over tasks. Where one box covers a whole cell, all others in that cell touch it and are linked to it alone; elsewhere the boxes of
a cell are compared, and a pair is reported by one cell only.

Edge cases: null texts and lines without ink have no runs; boxes with a null side have no region; a null doc_id is a page of its own; equal boxes are one in
links and are counted in regions; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formlake.functions.scratch import Table
from formlake.operators.graph import connected

SIDES = ("x1", "y1", "x2", "y2")


def _runs(line: str, between: re.Pattern, gap: int) -> list[tuple[int, int]]:
    """(x1, x2) of what stands between matches of `between` in a line, joined over matches of up to `gap` letters."""
    found, start = [], 0
    for gone in between.finditer(line):
        if start < gone.start() and gone.end() < len(line) and gone.end() - gone.start() <= gap:
            continue
        if gone.start() > start:
            found.append((start, gone.start()))
        start = gone.end()
    return [*found, (start, len(line))] if start < len(line) else found


def text_runs(docs: DataFrame, blank: str = r"\s", gap: int = 0) -> DataFrame:
    """Boxes of height 1 of each line's runs on the character grid: what stands between letters that match `blank` (Python's syntax), joined over up to `gap` of them.

    Texts are read once and nothing is shuffled; rows that share a doc_id are laid over one another."""
    between = re.compile(f"(?:{blank})+")

    @F.pandas_udf("array<struct<x1:int,x2:int>>")
    def runs(lines: pd.Series) -> pd.Series:
        return pd.Series([[{"x1": a, "x2": b} for a, b in _runs(line or "", between, gap)] for line in lines])

    line = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("y1", "line"))
    run = line.select("doc_id", "y1", F.explode(runs("line")).alias("r"))
    return run.select("doc_id", "r.x1", "y1", "r.x2", (F.col("y1") + 1).alias("y2"))


def _text_regions(text: str, between: re.Pattern, gap: int) -> list[dict]:
    """Regions of one text: runs of a line are united with those they touch in the line before, from left to right in both."""
    parent, box, before = [], [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for y, line in enumerate(text.split("\n")):
        now, at = [], 0
        for x1, x2 in _runs(line, between, gap):
            own = len(parent)
            parent.append(own)
            box.append((x1, y, x2))
            now.append((x1, x2, own))
            while at < len(before) and before[at][1] < x1:
                at += 1
            k = at
            while k < len(before) and before[k][0] <= x2:
                p, q = root(before[k][2]), root(own)
                parent[max(p, q)] = min(p, q)
                k += 1
            at = max(at, k - 1)  # the last one met may touch the next run too
        before = now
    found: dict[int, list[int]] = {}
    for i, (x1, y, x2) in enumerate(box):
        f = found.setdefault(root(i), [x1, y, x2, y + 1, 0])
        f[:] = min(f[0], x1), f[1], max(f[2], x2), y + 1, f[4] + 1
    return [dict(zip((*SIDES, "n"), f, strict=True)) for f in found.values()]


def text_regions(docs: DataFrame, blank: str = r"\s", gap: int = 0) -> DataFrame:
    """(doc_id, x1, y1, x2, y2, n) of the regions that `regions` finds in `text_runs`, each row being a page of its own.

    A text is in one row, so its regions are found where it is read: no shuffle, memory by the longest text."""
    between = re.compile(f"(?:{blank})+")

    @F.pandas_udf("array<struct<x1:long,y1:long,x2:long,y2:long,n:long>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([_text_regions(t or "", between, gap) for t in texts])

    return docs.select("doc_id", F.explode(found("text")).alias("r")).select("doc_id", "r.*")


def _numbered(boxes: DataFrame) -> Table:
    """Distinct boxes with how many rows each had and a number of its own, written once so that numbers stay."""
    whole = boxes.where(" and ".join(f"{s} is not null" for s in SIDES)).select("doc_id", *SIDES)
    return Table(whole.groupBy("doc_id", *SIDES).agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))


def _links(numbered: DataFrame, grid: int) -> DataFrame:
    """(a, b): numbers of touching boxes, enough to connect all that touch, by way of others too."""
    across, down = (F.explode(F.sequence(F.floor(F.col(a) / grid), F.floor(F.col(b) / grid))) for a, b in (("x1", "x2"), ("y1", "y2")))
    dealt = numbered.drop("n").withColumn("cx", across).withColumn("cy", down)
    inside = " and ".join(f"{s}1 <= c{s} * {grid} and {s}2 >= (c{s} + 1) * {grid}" for s in "xy")
    dealt = dealt.withColumn("hub", F.min(F.expr(f"case when {inside} then id end")).over(Window.partitionBy("doc_id", "cx", "cy")))
    spokes = dealt.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    p, q = (dealt.where("hub is null").alias(name) for name in "pq")
    same = F.expr("p.doc_id <=> q.doc_id and p.cx = q.cx and p.cy = q.cy and p.id < q.id")
    meet = F.expr(" and ".join(f"p.{s}1 <= q.{s}2 and q.{s}1 <= p.{s}2 and floor(greatest(p.{s}1, q.{s}1) / {grid}) = p.c{s}" for s in "xy"))
    return spokes.unionByName(p.join(q, same & meet).select(F.col("p.id").alias("a"), F.col("q.id").alias("b")))


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node connected to each of n nodes by the links (a, b)."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _united(box: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regions (x1, y1, x2, y2, n) of boxes, rows of four sides in order of their page, and each region's page."""
    links, left = [(np.zeros(0, dtype=np.int64),) * 2], np.arange(len(box))
    for step in range(1, len(box)):
        left = left[left + step < len(box)]
        left = left[page[left] == page[left + step]]
        if not len(left):
            break
        p, q = box[left], box[left + step]
        links.append((left[touch := ((p[:, :2] <= q[:, 2:]) & (q[:, :2] <= p[:, 2:])).all(axis=1)], left[touch] + step))
    root = _roots(*map(np.concatenate, zip(*links, strict=True)), len(box))
    order = np.argsort(root, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(root[order]) > 0])
    low, high = np.minimum.reduceat(box[order, :2], first), np.maximum.reduceat(box[order, 2:], first)
    return np.column_stack([low, high, np.diff(np.r_[first, len(box)])]), page[order][first]


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions of pages (doc_id, b: sides of all its boxes in a row), several pages side by side in up to about 4 million pairs."""
    for batch in batches:
        ends = batch.column("b").offsets.to_numpy().astype(np.int64)
        ends, sides = (ends - ends[0]) // 4, batch.column("b").flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        many = np.diff(ends)
        cuts = np.searchsorted(np.cumsum(many * many), np.arange(1, 2 + int((many * many).sum()) // 4_000_000) * 4_000_000, side="right")
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(many)], strict=True):
            if lo < hi:
                found, page = _united(sides[ends[lo] : ends[hi]], np.repeat(np.arange(lo, hi), many[lo:hi]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(page)), *[pa.array(c) for c in found.T]], ["doc_id", *SIDES, "n"])


def regions(boxes: DataFrame, grid: int = 64, few: int = 256) -> DataFrame:
    """(doc_id, x1, y1, x2, y2, n): the bounding box of each group of connected boxes, and how many it has.

    The surveyed merge of small boxes goes once through the list and depends on its order; here all that touch are one.
    A page of up to `few` boxes travels as one row and is solved where it arrives; the boxes of other pages are dealt over the grid."""
    kinds = dict(boxes.dtypes)
    whole = Table(boxes.where(" and ".join(f"{s} is not null" for s in SIDES)).select("doc_id", *SIDES)).df
    crowded = Table(whole.groupBy(F.col("doc_id").alias("page")).agg(F.count("*").alias("many")).where(F.col("many") > few).select("page")).df
    dense = not crowded.isEmpty()
    same = F.col("doc_id").eqNullSafe(F.col("page"))
    own = whole.join(crowded, same, "left_anti") if dense else whole
    rows = own.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array(*[F.col(s).cast("long") for s in SIDES]))).alias("b"))
    small = rows.mapInArrow(_pages, f"doc_id {kinds['doc_id']}, {', '.join(s + ' long' for s in SIDES)}, n long")
    small = small.select("doc_id", *[F.col(s).cast(kinds[s]).alias(s) for s in SIDES], "n")
    return small.unionByName(_crowded_regions(whole.join(crowded, same, "left_semi"), grid)) if dense else small


def _crowded_regions(boxes: DataFrame, grid: int) -> DataFrame:
    """Regions of pages with very many boxes: by links over grid cells, joined by stars."""
    numbered = _numbered(boxes).df
    roots = connected(_links(numbered, grid)).select(F.col("node").alias("id"), "root")
    labelled = numbered.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    sides = [F.min(s).alias(s) for s in ("x1", "y1")] + [F.max(s).alias(s) for s in ("x2", "y2")]
    return labelled.groupBy("root", "doc_id").agg(*sides, F.sum("n").alias("n")).select("doc_id", *SIDES, "n")


def ruled(runs: DataFrame, pages: DataFrame, part: int = 15) -> DataFrame:
    """Boxes of ruled lines: of runs (doc_id, x1, y1, x2, y2), one point thick across or down, those as long as one `part`th of the page.

    pages: (doc_id, width, height). That is what opening by a bar leaves. A page without a size has no ruled lines."""
    size = pages.select("doc_id", F.greatest(F.lit(1), F.floor(F.col("width") / part)).alias("across"), F.greatest(F.lit(1), F.floor(F.col("height") / part)).alias("down"))
    both = runs.join(size.withColumnRenamed("doc_id", "page"), F.col("doc_id").eqNullSafe(F.col("page")))
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return both.where(((high == 1) & (wide >= F.col("across"))) | ((wide == 1) & (high >= F.col("down")))).select("doc_id", *SIDES)


def tables(runs: DataFrame, pages: DataFrame, least: int = 50, grow: int = 1, grid: int = 64) -> DataFrame:
    """(doc_id, table_id, x1, y1, x2, y2) of areas of `least` by `least` points and more that connected ruled lines span, numbered from the top of each page.

    Lines count as connected over gaps of up to 2 * `grow` points, for each is grown by `grow` on all sides, and the box with them, inside the page."""
    lines = ruled(runs, pages)
    grown = lines.select("doc_id", *[(F.col(s) + (grow if s.endswith("2") else -grow)).alias(s) for s in SIDES])
    found = regions(grown, grid).join(pages.select(F.col("doc_id").alias("page"), "width", "height"), F.col("doc_id").eqNullSafe(F.col("page")))
    inside = found.select("doc_id", *[F.greatest(F.lit(0), F.col(s)).alias(s) for s in ("x1", "y1")], F.least("width", "x2").alias("x2"), F.least("height", "y2").alias("y2"))
    big = inside.where((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least))
    return big.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("y1", "x1", "y2", "x2")) - 1).alias("table_id"), *SIDES)


def table_cells(lines: DataFrame, found: DataFrame, least: tuple[int, int] = (15, 10), grid: int = 64) -> DataFrame:
    """(doc_id, table_id, cells): of each table the free areas that its ruled lines enclose, as array<struct<x,y,w,h>> by row, then column.

    lines: boxes from `ruled`; found: from `tables`. Areas smaller than `least` (across, down) are none, nor is one that is open to the table's edge, so that
    the surveyed outer boundary is left out. Tables without cells have no row."""
    sides = [F.col(s).cast("long").alias("t" + s) for s in SIDES]
    of = found.select(F.struct("doc_id", "table_id", *sides).alias("doc"), "doc_id", *sides)
    row = lines.select(F.col("doc_id").alias("page"), "x1", "x2", F.explode(F.sequence("y1", F.col("y2") - 1)).alias("y"))
    part = of.join(row, F.col("doc_id").eqNullSafe(F.col("page")) & (F.col("y") >= F.col("ty1")) & (F.col("y") < F.col("ty2")) & (F.col("x2") > F.col("tx1")) & (F.col("x1") < F.col("tx2")))
    ink = part.select("doc", "y", F.greatest("x1", "tx1").alias("x1"), F.least("x2", "tx2").alias("x2"))
    # a bar of no width at both edges of every row, so that free ends of rows and rows without ink count too
    edge = of.select("doc", F.explode(F.sequence("ty1", F.col("ty2") - 1)).alias("y"), F.explode(F.array("tx1", "tx2")).alias("x1")).withColumn("x2", F.col("x1"))
    w = Window.partitionBy("doc", "y").orderBy("x1", "x2")
    reach = F.max("x2").over(w.rowsBetween(Window.unboundedPreceding, -1))
    free = ink.unionByName(edge).withColumn("from", reach).where("x1 > from").select(F.col("doc").alias("doc_id"), F.col("from").alias("x1"), F.col("y").alias("y1"), F.col("x1").alias("x2"), (F.col("y") + 1).alias("y2"))
    # free runs that share no more than a corner are apart: half-open ends are drawn in by half a point, on a grid of doubled points
    drawn = free.select("doc_id", (F.col("x1") * 2 + 1).alias("x1"), (F.col("y1") * 2).alias("y1"), (F.col("x2") * 2 - 1).alias("x2"), (F.col("y2") * 2).alias("y2"))
    area = regions(drawn, 2 * grid).select("doc_id", ((F.col("x1") - 1) / 2).cast("long").alias("x"), (F.col("y1") / 2).cast("long").alias("y"), ((F.col("x2") + 1) / 2).cast("long").alias("r"), (F.col("y2") / 2).cast("long").alias("b"))
    cell = F.struct("y", "x", (F.col("r") - F.col("x")).alias("w"), (F.col("b") - F.col("y")).alias("h"))
    closed = area.where("x > doc_id.tx1 and y > doc_id.ty1 and r < doc_id.tx2 and b < doc_id.ty2")
    big = closed.where((F.col("r") - F.col("x") >= least[0]) & (F.col("b") - F.col("y") >= least[1]))
    cells = big.groupBy("doc_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    plain = F.transform("cells", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), c["w"].alias("w"), c["h"].alias("h")))
    return cells.select("doc_id.doc_id", "doc_id.table_id", plain.alias("cells"))

"""Import graphs: edges from sources, self loops, hot spots, strongly connected components, and cycles inside them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.functions.scratch import Table, kept


def scan_imports(files: DataFrame, package: str, proper: bool = False) -> DataFrame:
    """(src, dst) of the import statements at the start of lines in files (path, value), for modules below a package's folder.

    `import a.b as c, d` counts each name, `from a.b import c` the module a.b; names count if they begin with the package's.
    Relative imports climb by their dots: surveyed, from the module itself (`from .b import c` in p.a is p.a.b), and `__init__` is a module's
    name like any other; proper: from the module's package, as Python does, with `__init__` standing for its package. Dots that
    lead out of the package give no edge. Lines within strings aren't told from statements. Null texts and other paths have no edges."""
    own = F.regexp_extract("path", rf"(?:^|/)({package}/.*)\.py$", 1)
    parts = F.split(own, "/")
    named = F.regexp_extract_all("value", F.lit(r"(?m)^[ \t]*import[ \t]+([^\n\r#;]+)"), F.lit(1))
    names = F.transform(F.flatten(F.transform(named, lambda x: F.split(x, ","))), lambda x: F.regexp_extract(x, r"^\s*([\w.]+)", 1))
    sources = F.regexp_extract_all("value", F.lit(r"(?m)^[ \t]*from(?:[ \t]+|(?=\.))(\.+[ \t]*[\w.]*?|[\w.]+)[ \t]*\bimport\b"), F.lit(1))

    def target(x: Column) -> Column:
        module = F.regexp_extract(x, r"([\w][\w.]*)$", 1)
        level = F.length(F.regexp_extract(x, r"^(\.*)", 1))
        up = F.size("parts") - level + (0 if proper else 1)  # how many parts stay, the package's own folder among them
        base = F.concat(F.slice("parts", 1, F.greatest(up, F.lit(1))), F.when(module == "", F.array().cast("array<string>")).otherwise(F.array(module)))
        inside = up >= (1 if proper else 2)
        return F.when(module.startswith(package), module).when((level > 0) & inside, F.array_join(base, "."))

    rows = files.select(parts.alias("parts"), names.alias("names"), sources.alias("sources")).where("parts[0] <> ''")
    src = F.array_join("parts", ".")
    found = F.array_distinct(F.concat(F.filter("names", lambda x: x.startswith(package)), F.array_compact(F.transform("sources", target))))
    return rows.select((F.regexp_replace(src, r"\.__init__$", "") if proper else src).alias("src"), F.explode(found).alias("dst")).distinct()


def edges(rows: DataFrame) -> DataFrame:
    return rows.select("src", "dst").distinct()


def self_loops(rows: DataFrame) -> DataFrame:
    return rows.where("src = dst").select("src").distinct()


def in_degree(rows: DataFrame, top: int = 10) -> DataFrame:
    """The `top` modules with most importers."""
    return edges(rows).groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(top)


def _trimmed(step: DataFrame) -> DataFrame:
    """Edges whose ends both have an edge in and an edge out, until no more go: what is left lies on or between cycles."""
    n = step.count()
    while n:
        inner = step.select("src").distinct().join(step.select(F.col("dst").alias("src")).distinct(), "src")
        step = kept(step.join(inner, "src", "left_semi").join(inner.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"))
        before, n = n, step.count()
        if n == before:
            break
    return step


def _spread(start: DataFrame, step: DataFrame) -> DataFrame:
    """(node, colour): each node with the least colour of all nodes that reach it, its own included. start: (node, colour); every round all colours take one step."""
    now, unsettled = start, True
    while unsettled:
        came = now.join(step, now["node"] == step["src"]).select(F.col("dst").alias("node"), "colour")
        after = kept(now.unionByName(came).groupBy("node").agg(F.min("colour").alias("colour")))
        unsettled = not after.join(now.withColumnRenamed("colour", "before"), "node").where("colour < before").isEmpty()
        now = after
    return now


#: Edges that are solved together in one task at most.
SLICE = 200_000


def strong_parts(src: list[int], dst: list[int], n: int) -> list[int]:
    """The strongly connected part of each of n nodes, edges ordered by src (Tarjan). Parts are numbered from the ends of paths: an edge between parts leads to the lesser number."""
    start = np.searchsorted(src, np.arange(n + 1)).tolist()
    seen, low, part, stack, found, clock = [0] * n, [0] * n, [-1] * n, [], 0, 0
    at = start[:-1]
    for first in range(n):
        if seen[first]:
            continue
        way = [first]
        while way:
            u = way[-1]
            if not seen[u]:
                clock += 1
                seen[u] = low[u] = clock
                stack.append(u)
            if at[u] < start[u + 1]:
                v = dst[at[u]]
                at[u] += 1
                if not seen[v]:
                    way.append(v)
                elif part[v] < 0 and seen[v] < low[u]:
                    low[u] = seen[v]
                continue
            way.pop()
            if low[u] == seen[u]:
                while part[u] < 0:
                    part[stack.pop()] = found
                found += 1
            if way and part[u] < 0 and low[u] < low[way[-1]]:
                low[way[-1]] = low[u]
    return part


def _solved(edges: pd.DataFrame, whole: bool, cut: str | None) -> pd.DataFrame:
    """(src, dst, done) of a slice that holds all edges of its sources but `cut`: done rows are modules with their component, for parts
    that no path leaves for a module of other slices; other rows are the edges from which a path leaves. whole: there are no other slices."""
    code, names = pd.factorize(pd.concat([edges["src"], edges["dst"]], ignore_index=True))
    n, m = len(names), len(edges)
    order = np.argsort(code[:m], kind="stable")
    src, dst = code[:m][order], code[m:][order]
    part = np.array(strong_parts(src, dst.tolist(), n), dtype=np.int64)
    away = np.ones(n, dtype=bool)
    away[src] = names[src] == cut if cut is not None else False
    leaves = np.zeros(part.max() + 1, dtype=bool)
    if not whole:
        leaves[part[away]] = True
        a, b = part[src], part[dst]
        out = leaves.tolist()
        by = np.argsort(a, kind="stable")
        for i, j in zip(a[by].tolist(), b[by].tolist(), strict=True):
            if out[j]:
                out[i] = True
        leaves = np.array(out)
    left = leaves[part[dst]]
    node = np.flatnonzero((np.bincount(part)[part] > 1) & ~leaves[part])
    module = pd.Series(names[node])
    least = module.groupby(part[node]).transform("min") if len(node) else module
    return pd.concat([
        pd.DataFrame({"src": names[src[left]], "dst": names[dst[left]], "done": False}), pd.DataFrame({"src": module, "dst": least, "done": True})], ignore_index=True)


class _Slices:
    """Solves the edges of a partition, ordered by src, in slices of about `most`; a source with more edges than that is cut and its edges are left."""

    def __init__(self, most: int, whole: bool):
        self.most, self.whole = most, whole

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, cut = [], 0, None
        for b in batches:
            held.append(b)
            size += len(b)
            if size <= self.most or self.whole:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = rows["src"].iloc[-1]
            own = (rows["src"] != last).to_numpy()
            if own.any():
                yield _solved(rows[own], False, cut)
                cut, held = None, [rows[~own]]
            else:
                yield rows.assign(done=False)
                cut, held = last, []
            size = sum(map(len, held))
        if size:
            yield _solved(pd.concat(held, ignore_index=True), self.whole, cut)


def _in_slices(step: DataFrame, most: int, whole: bool) -> Table:
    """step's components and left edges, solved in slices of neighbouring names. Which edges meet in a slice decides how many are left, never a result."""
    dealt = step.coalesce(1) if whole else step.repartitionByRange("src").sortWithinPartitions("src")
    return Table(dealt.mapInPandas(_Slices(most, whole), "src string, dst string, done boolean"))


def components(rows: DataFrame, most: int = SLICE) -> DataFrame:
    """(module, component): the modules on cycles of two or more, with the least module of their strongly connected component.

    Modules import mostly within their package, and names sort by package: slices of up to `most` edges of neighbouring names are solved in
    tasks, and what no path leaves is done. The edges left are trimmed and dealt again while they become fewer by half; those that don't are
    coloured over all tasks (`_coloured`), so that a component of any size is found."""
    step = Table(rows.select("src", "dst").where("src <> dst").distinct())
    n, found = step.df.count(), None
    while n:
        whole = n <= most
        tried = _in_slices(step.df, most, whole)
        own = tried.df.where("done").select(F.col("src").alias("module"), F.col("dst").alias("component"))
        found = own if found is None else found.unionByName(own)
        if whole:
            break
        left, before = _trimmed(tried.df.where("not done").select("src", "dst")), n
        n = left.count()
        if n > before / 2:
            return found.unionByName(_coloured(left))
        step.drop()
        step = Table(left)
    step.drop()
    return rows.sparkSession.createDataFrame([], "module string, component string") if found is None else found


def _coloured(step: DataFrame) -> DataFrame:
    """components of trimmed edges of any size.

    Forward and backward colouring: every node takes the least node that reaches it, and within
    one colour those that reach the colour's own node, against the edges, are its component. Edges inside found components and between colours
    go, and the rest is trimmed and coloured anew. A step is a join and an aggregation on module names; each round finds a component in every colour."""
    none, found = step.sparkSession.createDataFrame([], "module string, component string"), None
    while not step.isEmpty():
        nodes = step.select(F.col("src").alias("node")).union(step.select("dst")).distinct()
        colour = _spread(nodes.withColumn("colour", F.col("node")), step)
        inside = step.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").where("c1 = c2")
        back = kept(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        # against the edges: a colour's own node has the colour as its mark, all others one that is greater than every name
        marks = colour.select("node", F.struct((F.col("node") != F.col("colour")).cast("int").alias("far"), "colour").alias("colour"))
        own = _spread(marks, back).where("colour.far = 0").select(F.col("node").alias("module"), F.col("colour.colour").alias("component"))
        own = kept(own)
        found = own if found is None else found.unionByName(own)
        done = own.select(F.col("module").alias("src"))
        rest = inside.select("src", "dst").join(done, "src", "left_anti").join(done.withColumnRenamed("src", "dst"), "dst", "left_anti")
        step = _trimmed(kept(rest.select("src", "dst")))
    if found is None:
        return none
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return found.join(sizes, "component", "left_semi").select("module", "component")


def connected(links: DataFrame) -> DataFrame:
    """(node, root): each node of the undirected links (a, b) with the least node connected to it, itself included.

    Large-star and small-star steps by turns: neighbours greater than a node, then those less, hang on the least node around it, until
    every node hangs on its root. Nodes of any type that can be ordered; the rounds grow with the logarithm of the longest path. Links of a node with itself
    don't make it one; no links give no rows."""

    def star(both: DataFrame) -> DataFrame:
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        return both.join(least, "a").select("a", "b", F.least("a", "m").alias("m"))

    def state(step: DataFrame):
        return step.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    step = Table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now, before = state(step.df), None
    while now != before:
        before, old = now, step
        large = star(old.df.unionByName(old.df.select(F.col("b").alias("a"), F.col("a").alias("b")))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = star(large.where("a <> b").distinct())
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l")).select("l.a", "l.b")
        step = Table(small.where("a <> b").distinct())
        old.drop()
        now = state(step.df)
    return step.df.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(step.df.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def cycles(rows: DataFrame, longest: int | None = None) -> DataFrame:
    """Simple cycles of 2 or more modules, each once, from its least module, as cycle array<string>; of any length unless `longest` is given.

    Paths grow only along edges inside one strongly connected component, and every length starts from the written paths of the one before."""
    part = components(rows)
    inside = edges(rows).where("src <> dst").join(part.select(F.col("module").alias("src"), F.col("component").alias("c1")), "src").join(part.select(F.col("module").alias("dst"), F.col("component").alias("c2")), "dst")
    step = kept(inside.where("c1 = c2").select("src", "dst"))
    paths = step.where("src < dst").select(F.array("src", "dst").alias("path"))
    found = None
    for length in count(2):
        if longest is not None and length > longest or longest is None and length > 2 and paths.isEmpty():
            return found
        ends = paths.select("path", F.element_at("path", -1).alias("src"))
        grown = kept(ends.join(step, "src").select("path", "dst"))
        closed = grown.where(F.col("dst") == F.col("path")[0]).select(F.col("path").alias("cycle"))
        found = closed if found is None else found.unionByName(closed)
        paths = grown.where((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))

"""Near-duplicate embeddings by a navigable small-world graph per shard, with recall audits and verified cosines.

Vectors with equal labels are compared. Equal vectors meet first and cost one node. The nodes of a label fall into shards of at most about
`shard_rows`; every two shards of a label (and each shard with itself) meet in one task, where the second shard's hierarchical
graph is built and all vectors of the first one are searched in it. Beams widen for a vector whose beam is full of hits, and for all
while a sample of searches, compared with a full scan of the shard, finds less than `recall` of the links; at the widest the
shard is scanned, so no cap loses links. Found pairs count only if their cosine in double precision reaches `least`.
A task returns for each node its number of links and one link to its part's least node, never the pairs; the parts are joined as
graph components.

Edge cases: vectors that are null, zero, or hold null or non-finite components, and rows with null label or vec_id, link with nothing;
vectors of different lengths are not compared; repeated rows are other vectors, each with its row; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.llm.common import Saved, components


class SmallWorld:
    """Hierarchical navigable small-world graph over unit vectors, built and searched for many vectors at once."""

    def __init__(self, x: np.ndarray, links: int = 12, beam: int = 48, seed: int = 1):
        self.x, self.links, self.beam = x, links, beam
        n = len(x)
        draw = np.random.default_rng(seed).random(n)
        level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(links)).astype(int)
        self.order = np.argsort(-level, kind="stable")  # nodes of high levels go in first at each level
        top = int(level.max()) if n else 0
        self.layers: list[np.ndarray] = []  # neighbours by node, from the top level down
        for at in range(top, -1, -1):
            self.layers.append(np.full((n, 2 * links), -1, dtype=np.int32))
            self._fill(self.order[: int((level >= at).sum())])

    def _fill(self, nodes: np.ndarray) -> None:
        """Puts nodes into the lowest layer so far, in batches that double it."""
        done = min(len(nodes), 128)
        self._connect(nodes[:done], nodes[:done], np.empty((done, 0), dtype=np.int32))
        while done < len(nodes):
            batch = nodes[done : done + min(done, 1024)]
            near, _ = self.search(self.x[batch], self.beam)
            self._connect(batch, batch, near)
            done += len(batch)

    def _connect(self, batch: np.ndarray, beside: np.ndarray, near: np.ndarray) -> None:
        """Chooses neighbours from the found ones and from the batch itself, and links both ways."""
        x, m = self.x, self.links
        own = x[batch] @ x[beside].T
        own[np.arange(len(batch)), np.arange(len(batch))] = -2
        k = min(16, len(beside) - 1)
        cand = near
        if k > 0:
            cand = np.hstack([near, beside[np.argpartition(-own, k - 1, axis=1)[:, :k]]])
        if not cand.shape[1]:
            return
        chosen = self._diverse(batch, cand, m)
        layer = self.layers[-1]
        layer[batch, :m] = chosen
        src, dst = np.repeat(batch, m), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        wide = int(count.max()) if len(count) else 0
        back = np.full((len(targets), wide), -1, dtype=np.int32)
        slot = np.arange(len(dst)) - np.repeat(first, count)
        back[np.repeat(np.arange(len(targets)), count), slot] = src
        for i in range(0, len(targets), 512):
            t = targets[i : i + 512]
            both = np.hstack([layer[t], back[i : i + 512]])
            full = (both >= 0).sum(axis=1) > 2 * m
            packed = -np.sort(-both, axis=1)[:, : 2 * m]
            if full.any():
                packed[full] = self._diverse(t[full], both[full][:, : 6 * m] if both.shape[1] <= 6 * m else self._nearest(t[full], both[full], 6 * m), 2 * m)
            layer[t] = packed

    def _nearest(self, nodes: np.ndarray, cand: np.ndarray, k: int) -> np.ndarray:
        sim = np.einsum("bd,bkd->bk", self.x[nodes], self.x[cand])
        sim[cand < 0] = -3
        return np.take_along_axis(cand, np.argpartition(-sim, k - 1, axis=1)[:, :k], 1)

    def _diverse(self, nodes: np.ndarray, cand: np.ndarray, keep: int) -> np.ndarray:
        """Of each row's candidates up to `keep`: first those nearer to the node than to any chosen before, then the nearest others."""
        out = np.full((len(nodes), keep), -1, dtype=np.int32)
        for i in range(0, len(nodes), 256):
            rows, c = nodes[i : i + 256], cand[i : i + 256]
            sim = np.einsum("bd,bkd->bk", self.x[rows], self.x[c])
            sim[(c < 0) | (c == rows[:, None])] = -3
            order = np.argsort(-sim, axis=1, kind="stable")[:, : 4 * keep]
            c, sim = np.take_along_axis(c, order, 1), np.take_along_axis(sim, order, 1)
            twice = np.zeros(c.shape, dtype=bool)
            by_id = np.argsort(c, axis=1, kind="stable")
            ids = np.take_along_axis(c, by_id, 1)
            np.put_along_axis(twice, by_id[:, 1:], ids[:, 1:] == ids[:, :-1], 1)
            sim[twice] = -3
            among = np.einsum("bkd,bld->bkl", self.x[c], self.x[c])
            picked = np.zeros(c.shape, dtype=bool)
            closest = np.full(c.shape, -2.0, dtype=np.float32)  # of each candidate to the chosen ones
            for k in range(c.shape[1]):
                take = (sim[:, k] > -2) & (sim[:, k] > closest[:, k]) & (picked.sum(axis=1) < keep)
                picked[:, k] = take
                closest = np.where(take[:, None], np.maximum(closest, among[:, k]), closest)
            rank = np.where(sim <= -2, 2, np.where(picked, 0, 1))
            best = np.argsort(rank, axis=1, kind="stable")[:, :keep]
            got = np.where(np.take_along_axis(rank, best, 1) < 2, np.take_along_axis(c, best, 1), -1)
            out[i : i + 256, : got.shape[1]] = got
        return out

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest nodes found (rows, beam) and their cosines, -1 and -3 where fewer were met."""
        ids, sims = np.empty((len(q), beam), dtype=np.int32), np.empty((len(q), beam), dtype=np.float32)
        for i in range(0, len(q), 1024):
            part = q[i : i + 1024]
            entry = np.full((len(part), 1), self.order[0], dtype=np.int32)
            for layer in self.layers[:-1]:
                entry = self._beam(part, layer, entry, 4)[0][:, :2]
            ids[i : i + 1024], sims[i : i + 1024] = self._beam(part, self.layers[-1], entry, beam)
        return ids, sims

    def _beam(self, q: np.ndarray, layer: np.ndarray, entry: np.ndarray, beam: int, step: int = 3) -> tuple[np.ndarray, np.ndarray]:
        x, b = self.x, len(q)
        rows = np.arange(b)
        seen = np.zeros((b, len(x)), dtype=bool)
        ids = np.full((b, beam), -1, dtype=np.int32)
        sims = np.full((b, beam), -3, dtype=np.float32)
        open_ = np.zeros((b, beam), dtype=bool)
        new, live = entry, rows
        while len(live):
            ok = (new >= 0) & ~seen[live[:, None], new]
            ok &= ~_repeated(new)
            seen[live[:, None], np.where(new >= 0, new, 0)] |= new >= 0
            s = np.einsum("bd,bkd->bk", q[live], x[np.maximum(new, 0)])
            s[~ok] = -3
            all_s, all_i = np.hstack([sims[live], s]), np.hstack([ids[live], np.where(ok, new, -1)])
            all_o = np.hstack([open_[live], ok])
            top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            sims[live], ids[live] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
            open_[live] = np.take_along_axis(all_o, top, 1)
            live = live[open_[live].any(axis=1)]
            if not len(live):
                break
            first = np.argsort(~open_[live], axis=1, kind="stable")[:, :step]  # the best that are open
            is_open = np.take_along_axis(open_[live], first, 1)
            picked = np.where(is_open, np.take_along_axis(ids[live], first, 1), -1)
            open_[live[:, None], first] = False
            new = np.where(picked[:, :, None] >= 0, layer[np.maximum(picked, 0)], -1).reshape(len(live), -1)
        return ids, sims


def _repeated(ids: np.ndarray) -> np.ndarray:
    """True for all but the first of equal values in each row."""
    order = np.argsort(ids, axis=1, kind="stable")
    sorted_ = np.take_along_axis(ids, order, 1)
    out = np.zeros(ids.shape, dtype=bool)
    np.put_along_axis(out, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
    return out


class _Links:
    """Links between two shards (or inside one), as numbers of links and each node's least reachable node here."""

    def __init__(self, least: float, recall: float, beam: int = 48, widest: int = 192):
        self.least, self.recall, self.beam, self.widest = least, recall, beam, widest

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["shard", "node"], kind="stable")
        exact = np.array(rows["embedding"].tolist(), dtype=np.float64)
        exact /= np.sqrt((exact * exact).sum(axis=1))[:, None]
        node, times, shard = (rows[c].to_numpy() for c in ("node", "n", "shard"))
        b = np.flatnonzero(shard == shard[-1])
        a = np.flatnonzero(shard == shard[0])
        if len(a) == len(rows) and rows["lo"].iloc[0] != rows["hi"].iloc[0]:
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")  # one of the two shards is empty
        found = self.matrix(exact[a], exact[b])
        if a[0] == b[0]:
            found |= found.T
            np.fill_diagonal(found, False)
            links, root = found @ times, _least(found, node)
            return pd.DataFrame({"node": node, "links": links.astype(np.int64), "root": root})
        n = len(rows)
        both = np.zeros((n, n), dtype=bool)
        both[np.ix_(a, b)] = found
        both |= both.T
        return pd.DataFrame({"node": node, "links": (both @ times).astype(np.int64), "root": _least(both, node)})

    def matrix(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """found[i, j]: the search for q[i] met x[j] and their cosine is high enough."""
        q32, x32 = q.astype(np.float32), x.astype(np.float32)
        graph = SmallWorld(x32, beam=self.beam)
        sample = np.arange(0, len(q), max(1, len(q) // 64))
        truth = q[sample] @ x.T >= self.least
        beam = self.beam
        while True:
            found = np.zeros((len(q), len(x)), dtype=bool)
            todo, width = np.arange(len(q)), beam
            while len(todo):
                if width >= min(len(x), self.widest):
                    for i in range(0, len(todo), 512):  # beams full of hits: the whole shard
                        t = todo[i : i + 512]
                        found[t] = q[t] @ x.T >= self.least
                    break
                ids, sims = graph.search(q32[todo], width)
                near = (sims >= self.least - 1e-4) & (ids >= 0)
                r, c = np.nonzero(near)
                r, c = todo[r], ids[r, c]
                for i in range(0, len(r), 200_000):
                    rr, cc = r[i : i + 200_000], c[i : i + 200_000]
                    found[rr, cc] = np.einsum("kd,kd->k", q[rr], x[cc]) >= self.least
                todo, width = todo[near.all(axis=1)], width * 2
            right = (found[sample] & truth).sum()
            if right >= self.recall * truth.sum() or beam >= min(len(x), self.widest):
                return found
            beam *= 2


def _least(found: np.ndarray, node: np.ndarray) -> np.ndarray:
    """For each row the least node that links reach."""
    root = node.copy()
    while True:
        new = root.copy()
        for i in range(0, len(node), 512):
            some = found[i : i + 512]
            near = np.where(some, root[None, :], np.iinfo(np.int64).max).min(axis=1)
            new[i : i + 512] = np.minimum(root[i : i + 512], near)
        if np.array_equal(new, root):
            return root
        root = new


def near_duplicates(vectors: DataFrame, least: float = 0.93, recall: float = 0.99, shard_rows: int = 6000) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    numbers = F.transform("embedding", lambda v: v.cast("double"))
    fit = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    fit &= F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    key = F.when(F.coalesce(fit, F.lit(False)), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("embedding", lambda v: v.cast("string"))), 256))
    rows = Saved(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", numbers.alias("embedding"), key.alias("key")))
    nodes = rows.df.where("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("n"), F.min("vec_id").alias("rep"))
    nodes = Saved(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")))
    sizes = nodes.df.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = nodes.df.select("label", "dim", "node", "n", "embedding").join(sizes, ["label", "dim"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("node"), "shards").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    dealt = dealt.withColumn("lo", F.least("shard", "other")).withColumn("hi", F.greatest("shard", "other"))
    linker = _Links(least, recall)
    parts = Saved(dealt.groupBy("label", "dim", "lo", "hi").applyInPandas(lambda part: linker(part), "node long, links long, root long"))
    links = parts.df.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(parts.df.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.df.select("node", "key", "n", "rep").join(links, "node", "left")
    if roots is None:
        known = known.withColumn("component", F.col("rep"))
    else:
        named = known.select("node", "rep").join(roots.df, "node")
        least_rep = named.groupBy("root").agg(F.min("rep").alias("component"))
        known = known.join(named.join(least_rep, "root").select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "rep"))
    found = rows.df.select("vec_id", "key").join(known.select("key", "n", "links", "component"), "key", "left")
    component = F.coalesce("component", "vec_id")
    return found.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Exact comparison of all pairs of a label; the graph search finds the same links on small tables.
OP4_SQL = """
with recursive v as (
  select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
fit as (
  select * from v where vec_id is not null and label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
link as (select a.rid as a, b.rid as b from fit a join fit b on a.label = b.label and a.rid <> b.rid and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
n as (select a as rid, count(*) as n_links from link group by a),
walk as (select rid, vec_id as root from fit union select link.b, walk.root from walk join link on link.a = walk.rid),
least as (select rid, min(root) as root from walk group by rid)
select vec_id, cast(coalesce(n_links, 0) as bigint) as n_links, coalesce(root, vec_id) as component_id, coalesce(coalesce(root, vec_id) = vec_id, true) as kept
from v left join n using (rid) left join least using (rid)
"""

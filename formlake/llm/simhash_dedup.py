"""SimHash near-duplicate documents, with pivot distance tables.

A fingerprint has a bit set where over half of the XXH64 hashes (seed 42) of the text's 3-word shingles have it. Equal
fingerprints meet first, so copies cost one row. Each distinct fingerprint gets its row of the pivot table: its Hamming
distances to many reference fingerprints. Two fingerprints at distance d differ by at most d in every coordinate, so a pair
whose largest coordinate difference exceeds the limit is discarded; survivors are verified by their own distance.

On 64 bits such tables alone can't choose the pairs to look at without comparing all with all (distances to a
reference crowd around 32), so pairs come from blocks: fingerprints within `differ` bits are equal on some `blocks -
differ` of `blocks` runs of bits. Nothing is lost by that, and the pivot table then discards the chance meetings.

Edge cases: null, empty and blank texts have fingerprint zero and link like any other; a null doc_id gets a row, and the component
of documents that all lack ids is null; repeated rows each get their row; an empty table gives no rows; further columns
are kept by `dedup` and ignored by `classes`.

`dedup_copies`, the pipeline's stage, takes documents for near copies whose 5-word shingles have a Jaccard similarity of 0.8 or more. It goes the
same way: fingerprints of distinct shingles, blocks, pivot table, distance; then a pair's own shingles decide. Such pairs differ in ten bits on
average, and blocks of 64 bits find those within three, so the others are added by MinHash keys (missed in about 2 of 10,000 cases at 0.8). The limit of the
pivot table and of the distance (`FAR`) is wide enough for such pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.llm.common import Saved, band_keys, block_bucket, block_masks, bucket_links, components, in_blocks, majority, mixed, shared_keys, shielded, text_key


def shingle_hashes(text: str | None, size: int = 3) -> list[int]:
    w = text.encode("utf-8").lower().split() if text else []  # of bytes: A-Z and the ASCII blanks only
    if not w:
        return []
    if len(w) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(w), 42)]
    return [xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False))]


def fingerprints(texts: list[str | None], size: int = 3) -> np.ndarray:
    """Signed 64-bit fingerprints."""
    out, at = np.zeros(len(texts), dtype=np.int64), 0
    while at < len(texts):
        hashes, starts, who = [], [], []
        while at < len(texts) and len(hashes) < 400_000:
            own = shingle_hashes(texts[at], size)
            if own:
                starts.append(len(hashes))
                who.append(at)
                hashes += own
            at += 1
        if who:
            out[who] = majority(np.array(hashes, dtype=np.uint64), np.array(starts))
    return out


class _Fingerprint:
    def __init__(self, size: int):
        self.size = size

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tk": b["tk"], "fp": fingerprints(b["text"].tolist(), self.size)})


class PivotFilter:
    """Discards pairs by the pivot table, then verifies the distance."""

    def __init__(self, differ: int, pivots: int = 16, column: str = "id"):
        self.differ, self.column = differ, column
        self.pivots = np.array([xxhash.xxh64_intdigest(f"pivot {i}", 42) for i in range(pivots)], dtype=np.uint64)

    def table(self, fp: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fp[:, None] ^ self.pivots[None, :]).astype(np.int8)

    def __call__(self, rows: pd.DataFrame):
        fp = rows[self.column].to_numpy().view(np.uint64)
        table = self.table(fp)

        def link(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            near = np.abs(table[x] - table[y]).max(axis=1) <= self.differ
            near[near] = np.bitwise_count(fp[x[near]] ^ fp[y[near]]) <= self.differ
            return near

        return link


def classes(docs: DataFrame, differ: int = 3, blocks: int = 5, pivots: int = 16, size: int = 3) -> DataFrame:
    """doc_id, tk (key of the text), fp (signed), component_id: the smallest doc_id reachable by links, root: a fingerprint that stands for the component, never null."""
    kind = dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", text_key(F.col("text")).alias("tk"), "text")
    rows = Saved(slim.mapInPandas(_Fingerprint(size), f"doc_id {kind}, tk string, fp long"))
    own = Saved(rows.df.groupBy("fp").agg(F.min("doc_id").alias("first")))
    distinct = in_blocks(own.df.select(F.col("fp").alias("id")), blocks, differ)
    roots = components(bucket_links(distinct, PivotFilter(differ, pivots), block_bucket("id", blocks, differ)))
    if roots is None:
        label = own.df.select("fp", F.col("first").alias("component_id"), F.col("fp").alias("root"))
    else:
        linked = roots.df.join(own.df, F.col("node") == F.col("fp"))
        least = linked.groupBy("root").agg(F.min("first").alias("least"))
        least = linked.join(least, "root").select("fp", "least", "root")
        label = own.df.join(least, "fp", "left").select("fp", F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.col("first")).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    # written first, so that a fingerprint with very many documents is a join key that adaptive execution can split
    return rows.df.join(Saved(label).df, "fp")


def dedup(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, then of the smallest text key."""
    found = classes(docs, **options)
    best = found.groupBy("root").agg(F.min(F.struct("doc_id", "tk")).alias("best")).select("best.*")
    return _rows_of(docs, best.select(F.col("doc_id").alias("best_id"), F.col("tk").alias("best_tk")))


def _rows_of(docs: DataFrame, best: DataFrame) -> DataFrame:
    """One row of docs, with its columns, for each (best_id, best_tk)."""
    named, back = shielded(docs, "doc_id", "text")
    named = named.withColumn("tk", text_key(F.col("text")))
    kept = named.join(best, F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("tk") == F.col("best_tk")), "left_semi")
    return kept.dropDuplicates(["doc_id", "tk"]).select(*back)


#: Above the bits of 64 in which fingerprints of shingle sets with a Jaccard similarity of 0.8 differ: 27 at most among 520,000 made-up pairs of 4 to
#: 100 shingles, 8 to 12 on average. Unrelated ones differ in 32, give or take 4.
FAR = 31


def block_keys(fp: np.ndarray, blocks: int, differ: int) -> np.ndarray:
    """Keys (fingerprints, masks): equal for fingerprints that agree under a mask, unlike band_keys of kind 0."""
    masks = np.array(block_masks(blocks, differ), dtype=np.uint64)
    own = np.arange(len(masks), dtype=np.uint64)
    key = mixed((fp.view(np.uint64)[:, None] & masks) ^ mixed(own + np.uint64(1)))
    return ((key >> np.uint64(32)) | (np.uint64(1 << 8) + own) << np.uint64(32)).view(np.int64)


class _Copies:
    """A row for each document: its id (of equal words), its fingerprint, and the keys of its fingerprint and its shingles; no keys without words."""

    def __init__(self, size: int, bands: int, width: int, blocks: int, differ: int):
        self.size, self.bands, self.width, self.blocks, self.differ = size, bands, width, blocks, differ

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                texts = part["text"].tolist()
                ids = [xxhash.xxh64_intdigest(b" ".join(t.encode("utf-8").lower().split()) if t else b"", 7) for t in texts]
                own = [np.unique(np.array(shingle_hashes(t, self.size), dtype=np.uint64)) for t in texts]
                size = np.array([len(h) for h in own])
                keys, some, fp = [[]] * len(own), np.flatnonzero(size), np.zeros(len(own), dtype=np.int64)
                if len(some):
                    starts, hashes = np.cumsum(size[some]) - size[some], np.concatenate(own)
                    fp[some] = majority(hashes, starts)
                    all_keys = np.hstack([block_keys(fp[some], self.blocks, self.differ), band_keys(mixed(hashes), starts, self.bands, self.width)])
                    for i, k in zip(some.tolist(), all_keys, strict=True):
                        keys[i] = k
                yield pd.DataFrame({"doc_id": part["doc_id"], "tk": part["tk"], "id": np.array(ids, dtype=np.uint64).view(np.int64), "fp": fp, "keys": keys})


class _Jaccard:
    """Jaccard similarity of the texts' distinct shingles, of pairs that pivot table and distance of their fingerprints leave."""

    def __init__(self, least: float, size: int, near: PivotFilter):
        self.least, self.size, self.near = least, size, near

    def __call__(self, rows: pd.DataFrame):
        _, first, at = np.unique(rows["id"].to_numpy(), return_index=True, return_inverse=True)
        texts, near = rows["text"].tolist(), self.near(rows)
        sets = [np.unique(np.array(shingle_hashes(texts[i], self.size), dtype=np.uint64)) for i in first]

        def link(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = near(x, y)
            for k in np.flatnonzero(out).tolist():
                a, b = sets[at[x[k]]], sets[at[y[k]]]
                both = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) >= self.least * max(len(a), len(b)) else 0
                out[k] = both > 0 and both >= self.least * (len(a) + len(b) - both) - 1e-9
            return out

        return link


def dedup_copies(docs: DataFrame, least: float = 0.8, size: int = 5, bands: int = 16, width: int = 4, far: int = FAR, blocks: int = 5, differ: int = 3, pivots: int = 16) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id, then of the smallest text key."""
    kind = dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", text_key(F.col("text")).alias("tk"), "text")
    rows = slim.mapInPandas(_Copies(size, bands, width, blocks, differ), f"doc_id {kind}, tk string, id long, fp long, keys array<long>")
    own = Saved(rows.groupBy("id").agg(F.min(F.struct("doc_id", "tk")).alias("first"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys")))
    met = shared_keys(own.df.select("id", "keys"))
    some = own.df.join(met.df.select("id").distinct().hint("merge"), "id").select("id", "fp", F.col("first.doc_id").alias("at_id"), F.col("first.tk").alias("at_tk"))
    texts = slim.join(some.hint("merge"), F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("tk") == F.col("at_tk"))).select("id", "fp", "text")
    texts = Saved(texts.groupBy("id").agg(F.min("fp").alias("fp"), F.min("text").alias("text")))
    roots = components(bucket_links(met.df.join(texts.df.hint("merge"), "id"), _Jaccard(least, size, PivotFilter(far, pivots, "fp")), chunk=1024))
    best = own.df.select("id", "first")
    if roots is not None:
        best = best.join(roots.df.withColumnRenamed("node", "id").hint("merge"), "id", "left").groupBy(F.coalesce("root", "id").alias("id")).agg(F.min("first").alias("first"))
    best = Saved(best.select(F.col("first.doc_id").alias("best_id"), F.col("first.tk").alias("best_tk")))
    for table in (own, met, texts):
        table.drop()
    return _rows_of(docs, best.df)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

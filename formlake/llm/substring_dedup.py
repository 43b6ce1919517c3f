"""Substring deduplication over a log-structured fingerprint index.

The unit is a window of `size` consecutive words. Each window names an anchor: the least hash among the runs of `anchor` words
inside it, so equal windows always name equal anchors in equal places, and neighbouring windows mostly name the same one. The index
holds a row for each anchor and context (all the words that the windows with that anchor span) with its first occurrence, about a
fourteenth of a row per window. Rows stand in immutable runs sorted by anchor. A new batch is joined with the runs by
anchor; a context that an earlier document holds is repeated as a whole; where an anchor has several contexts, the window hashes
of their first occurrences are worked out from the documents and compared one by one. Anchors, contexts and windows are hashed from independent
64-bit hashes of the words, so an equality is verified by 128 bits. Batches go in by rising doc_id; a window is repeated if its words also
start in a document with a smaller doc_id. Then the batch's new contexts become a run, and runs are merged when there are many.

Edge cases: null and empty texts have no words and nothing to remove; texts of fewer words than a window have no windows;
documents with null doc_id are returned unchanged and remove nothing; rows that share doc_id don't remove each other;
repeated rows each get their row; an empty table gives no rows; texts of any length are read whole; further columns are ignored.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.llm.common import Saved, remove, scratch_root

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _WordHashes(dict):
    def __init__(self, seed: int):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        if len(self) < 400_000:
            self[word] = h
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of runs of words by differences of a polynomial's prefix sums modulo 2 ** 64."""

    def __init__(self, seed: int):
        self.words = _WordHashes(seed)
        self.power = np.ones(1, dtype=np.uint64)
        self.inverse = np.ones(1, dtype=np.uint64)

    def prefix(self, words: list[bytes]) -> np.ndarray:
        n = len(words)
        if len(self.power) <= n:
            with np.errstate(over="ignore"):
                size = max(n + 1, 2 * len(self.power))
                self.power = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, BASE)], dtype=np.uint64)
                self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, BASE_INVERSE)], dtype=np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=n)
        return np.r_[np.uint64(0), np.cumsum(h * self.power[:n], dtype=np.uint64)]

    def runs(self, prefix: np.ndarray, start: np.ndarray, length) -> np.ndarray:
        return mixed((prefix[start + length] - prefix[start]) * self.inverse[start] + np.asarray(length, dtype=np.uint64))


def anchors(prefix: np.ndarray, roll: Rolling, other: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor: first window, number of windows, anchor hash, context hash (both signed).

    other: prefix sums of independent word hashes, from which the context's hash comes, so that it verifies what the anchor's hash finds."""
    n = len(prefix) - 1
    every = roll.runs(prefix, np.arange(n - anchor + 1), anchor)
    inside = size - anchor + 1
    at = np.lib.stride_tricks.sliding_window_view(every, inside).argmin(axis=1) + np.arange(n - size + 1)
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[start, len(at)])
    where = at[start]
    context = roll.runs(other, start, count + size - 1) ^ mixed((where - start).astype(np.uint64) + np.uint64(1))
    return start, count, every[where].view(np.int64), context.view(np.int64)


class _Anchors:
    def __init__(self, size: int, anchor: int):
        self.size, self.anchor = size, anchor
        self.roll, self.other = Rolling(11), Rolling(13)

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            held = 0
            for doc, tk, text in zip(b["doc_id"].tolist(), b["tk"].tolist(), b["text"].tolist(), strict=True):
                words = text.encode("utf-8").split() if text else ()
                if len(words) < self.size:
                    continue
                start, count, fp, context = anchors(self.roll.prefix(words), self.roll, self.other.prefix(words), self.size, self.anchor)
                out.append((np.full(len(start), doc), np.full(len(start), tk), start, count, fp, context))
                held += len(start)
                if held > 200_000:
                    yield self.frame(out)
                    out, held = [], 0
            if out:
                yield self.frame(out)

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        names = ("doc_id", "tk", "start", "count", "fp", "context")
        return pd.DataFrame({k: np.concatenate([x[i] for x in out]) for i, k in enumerate(names)}).astype({"start": "int32", "count": "int32"})


class _Windows:
    """Window hashes of the contexts listed beside each document, from word hashes with another seed than the anchors'."""

    def __init__(self, size: int):
        self.size, self.roll = size, Rolling(12)

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 200):
                part, out = b.iloc[at : at + 200], []
                for doc, text, need in zip(part["doc_id"].tolist(), part["text"].tolist(), part["need"].tolist(), strict=True):
                    prefix = self.roll.prefix(text.encode("utf-8").split())
                    start, count, fp, context = (np.array([x[k] for x in need], dtype=np.int64) for k in ("start", "count", "fp", "context"))
                    row = np.repeat(np.arange(len(need)), count)
                    i = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                    w = self.roll.runs(prefix, start[row] + i, self.size).view(np.int64)
                    out.append((np.full(len(row), doc), fp[row], context[row], i, w))
                if out:
                    names = ("doc_id", "fp", "context", "i", "w")
                    yield pd.DataFrame({k: np.concatenate([x[j] for x in out]) for j, k in enumerate(names)}).astype({"i": "int32"})


class _Cut:
    """What is left of each text without the words that the listed windows cover."""

    def __init__(self, size: int):
        self.size = size

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, gone in zip(b["text"].tolist(), b["gone"].tolist(), strict=True):
                words = text.encode("utf-8").split() if text else []
                n = len(words)
                if gone is not None and len(gone):
                    edge = np.zeros(n + 1, dtype=np.int64)
                    start = np.array([x["start"] for x in gone], dtype=np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + np.array([x["count"] for x in gone], dtype=np.int64) + self.size - 1, -1)
                    keep = np.cumsum(edge)[:n] == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                kept = b" ".join(words)
                rows.append((n, n - len(words), sha256(kept).hexdigest(), kept.decode("utf-8")))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept_text"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out


RUN = "fp long, context long, at struct<doc_id: long, tk: long, start: int, count: int>"
OCCURRENCE = "doc_id long, tk long, start int, count int, fp long, context long"


class FingerprintIndex:
    """Immutable runs of (fp, context, first occurrence), sorted by fp; documents go in by batches of rising doc_id.

    path: a folder that the executors share; runs that lie there from before, also from another session, belong to the index. A run is written
    under a name of its own and counts once it is complete (Spark's marker _SUCCESS), so a failed ingest leaves the index as it was."""

    def __init__(self, spark: SparkSession, path: str | None = None, size: int = 50, anchor: int = 25, most_runs: int = 4):
        self.spark, self.size, self.anchor, self.most_runs = spark, size, anchor, most_runs
        self.path = path or f"{scratch_root(spark)}/formlake/index-{uuid.uuid4().hex}"

    @property
    def runs(self) -> list[str]:
        """Folders of the complete runs; a compacted run replaces all runs before it, whether they are gone yet or not."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = sorted(str(x.getPath().getName()) for x in fs.listStatus(at)) if fs.exists(at) else []
        whole = [x for x in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}/_SUCCESS"))]
        last = max((i for i, x in enumerate(whole) if x.endswith("compacted")), default=0)
        return [f"{self.path}/{x}" for x in whole[last:]]

    def rows(self) -> DataFrame | None:
        runs = self.runs
        return self.spark.read.schema(RUN).parquet(*runs) if runs else None

    def write(self, contexts: DataFrame, kind: str = "batch") -> None:
        name = f"run-{time.time_ns():020d}-{kind}"
        contexts.select("fp", "context", "at").sortWithinPartitions("fp", "context").write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        if kind == "batch" and len(self.runs) > self.most_runs:
            self.compact()

    def compact(self) -> None:
        """All runs become one; of a context that stands in several the first occurrence stays."""
        old = self.runs
        self.write(self.rows().groupBy("fp", "context").agg(F.min("at").alias("at")), "compacted")
        for run in old:
            remove(self.spark, run)

    def ingest(self, batch: DataFrame, documents: DataFrame, keep: bool = True) -> Saved:
        """Ranges of repeated windows in the batch (doc_id, tk, start, count), then the batch belongs to the index.

        batch, documents: doc_id (long, not null), text; documents holds at least all documents that were ingested, and the batch.
        keep: False for a last batch, when nothing will be held against the index any more."""
        slim = batch.select("doc_id", F.xxhash64("text").alias("tk"), "text")
        own = Saved(slim.mapInPandas(_Anchors(self.size, self.anchor), OCCURRENCE))
        at = F.min(F.struct("doc_id", "tk", "start", "count")).alias("at")
        fresh = Saved(own.df.groupBy("fp", "context").agg(at))
        known = self.rows()
        merged = fresh.df
        if known is not None:
            old = known.join(fresh.df.select("fp"), "fp", "left_semi")
            merged = Saved(fresh.df.unionByName(old).groupBy("fp", "context").agg(F.min("at").alias("at")))
        first = merged.df if isinstance(merged, Saved) else merged
        several = first.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
        need = first.join(several, "fp", "left_semi").select("fp", "context", "at.*")
        need = need.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("start", "count", "fp", "context")).alias("need"))
        texts = documents.select("doc_id", F.xxhash64("text").alias("tk"), "text").join(need, ["doc_id", "tk"]).select("doc_id", "text", "need")
        windows = Saved(texts.mapInPandas(_Windows(self.size), "doc_id long, fp long, context long, i int, w long").distinct())
        shared = windows.df.groupBy("fp", "w").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
        earlier = windows.df.join(shared, ["fp", "w"]).where("least < doc_id").select("doc_id", "fp", "context", "i")
        firsts = first.select("fp", "context", F.col("at.doc_id").alias("first"))
        whole = own.df.join(firsts, ["fp", "context"]).where("doc_id > first").select("doc_id", "tk", "start", "count")
        single = own.df.join(earlier, ["fp", "context", "doc_id"]).select("doc_id", "tk", (F.col("start") + F.col("i")).alias("start"), F.lit(1).alias("count"))
        ranges = Saved(whole.union(single))
        windows.drop()
        own.drop()
        if keep:
            self.write(fresh.df if known is None else fresh.df.join(known.select("fp", "context"), ["fp", "context"], "left_anti"))
        fresh.drop()
        if isinstance(merged, Saved):
            merged.drop()
        return ranges

    def drop(self) -> None:
        remove(self.spark, self.path)


def dedup(docs: DataFrame, size: int = 50, anchor: int = 25, batches: int = 2, most_runs: int = 4) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of each document, ingested in `batches` by rising doc_id."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = slim.where("doc_id is not null")
    cuts = sorted(set(named.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    index, found = FingerprintIndex(spark, None, size, anchor, most_runs), None
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        inside = named
        inside = inside if lo is None else inside.where(F.col("doc_id") > lo)
        inside = inside if hi is None else inside.where(F.col("doc_id") <= hi)
        ranges = index.ingest(inside, named if hi is None else named.where(F.col("doc_id") <= hi), keep=hi is not None)
        found = ranges.df if found is None else found.union(ranges.df)
    index.drop()
    gone = found.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("start", "count")).alias("gone"))
    joined = slim.withColumn("tk", F.xxhash64("text")).join(gone, ["doc_id", "tk"], "left").select("doc_id", "text", "gone")
    return joined.mapInPandas(_Cut(size), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP2_SQL = r"""
with doc as (
  select row_number() over () as rid, doc_id, coalesce(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) as w from documents),
spot as (select rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as g from doc, unnest(range(1, len(w) - 48)) t(i)),
first as (select g, min(doc_id) as least from spot group by g),
hit as (select rid, i from spot join first using (g) where least < doc_id),
gone as (select distinct rid, i + k as j from hit, unnest(range(0, 50)) t(k)),
word as (select rid, j, w[j] as v from doc, unnest(range(1, len(w) + 1)) t(j)),
kept as (select rid, string_agg(v, ' ' order by j) as t, count(*) as n from word anti join gone using (rid, j) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from doc left join kept using (rid)
"""

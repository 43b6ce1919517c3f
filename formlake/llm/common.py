"""Helpers that the operators of this subpackage share: scratch tables, graph components, bucketed pair search."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
#: Plain capitals and their small letters, for lower-casing that leaves other letters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_written: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where the setting is unset and Spark runs in one process."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="formlake-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


class Saved:
    """A table written to the shared scratch folder: cuts the lineage and outlives lost executors."""

    def __init__(self, df: DataFrame, partition_by: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{scratch_root(self.spark)}/formlake/{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path)
        self.schema = df.schema
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _written.append((self.spark, self.path))

    def drop(self) -> None:
        remove(self.spark, self.path)
        _written[:] = [x for x in _written if x[1] != self.path]


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def shielded(df: DataFrame, *plain: str) -> tuple[DataFrame, list[Column]]:
    """df with all columns but `plain` renamed by place, so that no column of an operator's own clashes, and the columns that undo it."""
    own = {c: c if c in plain else f"given {i}" for i, c in enumerate(df.columns)}
    return df.toDF(*own.values()), [F.col(f"`{a}`").alias(c) for c, a in own.items()]


def folded(text: Column) -> Column:
    """A-Z in lower case; all other letters unchanged."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column, blanks: str = BLANKS) -> Column:
    """The non-empty pieces between blanks; no words for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), blanks, -1), lambda w: w != "")


def text_key(text: Column) -> Column:
    """Digest under which equal texts meet; null has a key of its own."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit("null"))


def components(edges: DataFrame, rounds: int = 60) -> Saved | None:
    """Connected components of edges (a, b), both long: (node, root) with root the smallest node reached.

    Alternates joining larger neighbours and smaller neighbours to the least one, which halves paths each time.
    Every step is an aggregation and a join on node ids; a node of very many links is a skewed join key, which
    adaptive execution splits. Nodes without edges have no row. None for no edges at all.
    """
    now = Saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    print_ = _fingerprint(now.df)
    if print_[0] == 0:
        now.drop()
        return None
    for _ in range(rounds):
        large = _connect(now.df.union(now.df.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger=True)
        small = _connect(large, larger=False)
        after = Saved(small.distinct())
        now.drop()
        now, before, print_ = after, print_, _fingerprint(after.df)
        if print_ == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = Saved(now.df.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.df.select(F.col("b"), F.col("b"))).distinct())
    now.drop()
    return roots


def _fingerprint(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _connect(links: DataFrame, larger: bool) -> DataFrame:
    """larger: each node's larger neighbours join its least neighbour or itself. Else: its smaller ones do."""
    own = links if larger else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = own.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m") if larger else F.min("b").alias("m"))
    joined = own.join(least, "a")
    if larger:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


#: Given one sorted frame, says for two arrays of row positions which pairs link.
Verify = Callable[[pd.DataFrame], Callable[[np.ndarray, np.ndarray], np.ndarray]]


def bucket_links(
    rows: DataFrame, verify: Verify, bucket: Column | None = None, chunk: int = 8192, sampled: int = 64, counted: DataFrame | None = None
) -> DataFrame:
    """Verified links between rows of equal bucket, as spanning edges (a, b) of what each task saw.

    rows: id (long), further columns for verify; bucket: an expression over them, else the column bucket. Only the columns travel, the
    bucket is worked out again where rows arrive. counted: the rows' id and bucket from a table that is quicker to read. Buckets of more than about `chunk` rows are found by
    counting the ids with one of `sampled` hash values; such a bucket is dealt into chunks and every two chunks meet in a
    group of their own: all its pairs are still compared, in bounded memory and many tasks. The sample only decides who is
    split, never who is compared. Edges that join two parts already joined are not made, so a dense group of n
    rows gives n - 1.
    """
    bucket = F.col("bucket") if bucket is None else bucket
    keep = [c for c in rows.columns if c not in ("bucket", "id")]
    some = (rows if counted is None else counted).where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(sampled)) == 0)
    hot = Saved(some.groupBy(bucket.alias("bucket")).agg((F.count("*") * sampled).alias("n")).where(F.col("n") > chunk))
    if hot.df.isEmpty():
        dealt = rows.repartition(bucket).select(bucket.alias("grp"), bucket.alias("bucket"), "id", *keep)
    else:
        parts = F.ceil(F.coalesce("n", F.lit(1)) / chunk).cast("int")
        mine = F.pmod(F.xxhash64("id", "bucket"), "parts").cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        pair = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))
        dealt = (
            rows.withColumn("bucket", bucket).join(hot.df, "bucket", "left").withColumn("parts", parts).withColumn("mine", mine).withColumn("other", other)
            .select(F.when(F.col("parts") == 1, F.col("bucket")).otherwise(pair).alias("grp"), "bucket", "id", *keep).repartition("grp")
        )
    return dealt.sortWithinPartitions("grp", "bucket").mapInPandas(_Linker(verify), "a long, b long")


#: Rows further apart than this wait until so many pairs can be verified in one call; a verify may have its own `at_once` and `pairs`.
AT_ONCE, PAIRS = 8, 2048


#: So much of what `weigh` of a verify counts is gathered before groups are worked out; without `weigh` they are as soon as they are complete.
SLAB = 64_000_000


class _Linker:
    def __init__(self, verify: Verify):
        self.verify = verify

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        weigh = getattr(self.verify, "weigh", lambda batch: SLAB)
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += weigh(batch)
            last = batch["grp"].iloc[-1]  # this group may go on in the next batch
            if size < SLAB or held[0]["grp"].iloc[0] == last:
                continue
            done = pd.concat(held, ignore_index=True)
            cut = int(np.searchsorted(done["grp"].to_numpy(), last, side="left"))
            held = [done.iloc[cut:]]
            size = weigh(held[0])
            yield self.links(done.iloc[:cut])
        if held:
            yield self.links(pd.concat(held, ignore_index=True))

    def links(self, rows: pd.DataFrame) -> pd.DataFrame:
        key = rows["grp"].to_numpy()
        again = key[1:] == key[:-1]
        rows = rows[np.r_[again, False] | np.r_[False, again]]  # most rows have their bucket to themselves
        key = rows["grp"].to_numpy()
        same_bucket = rows["bucket"].to_numpy()
        ids = rows["id"].to_numpy()
        n = len(rows)
        nodes, at = np.unique(ids, return_inverse=True)
        parent = np.arange(len(nodes))
        out_a, out_b = [], []
        test = self.verify(rows)
        waiting, held = [], 0

        def join() -> None:
            nonlocal parent, held
            if held:
                x, y = (np.concatenate(side) for side in zip(*waiting, strict=True))
                good = test(x, y)
                for i, j in zip(at[x[good]].tolist(), at[y[good]].tolist(), strict=True):
                    ri, rj = find(parent, i), find(parent, j)
                    if ri != rj:
                        parent[max(ri, rj)] = min(ri, rj)
                        out_a.append(nodes[i])
                        out_b.append(nodes[j])
                if good.any():
                    parent = flatten(parent)
            waiting.clear()
            held = 0

        left = np.arange(n - 1)
        for step in range(1, n):
            left = left[left + step < n]
            left = left[key[left] == key[left + step]]
            if not len(left):
                break
            right = left + step
            ok = (same_bucket[left] == same_bucket[right]) & (at[left] != at[right])
            ok &= parent[at[left]] != parent[at[right]]
            waiting.append((left[ok], right[ok]))
            held += len(waiting[-1][0])
            if step <= getattr(self.verify, "at_once", AT_ONCE) or held >= getattr(self.verify, "pairs", PAIRS):
                join()
        join()
        return pd.DataFrame({"a": np.array(out_a, dtype=np.int64), "b": np.array(out_b, dtype=np.int64)})


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(h: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def mixed_here(h: np.ndarray, spare: np.ndarray | None = None) -> np.ndarray:
    """As `mixed`, in the array's own memory; `spare` is as long and written over."""
    part = np.right_shift(h, np.uint64(30), out=spare)
    for k, turn in ((_MIX[1], 27), (_MIX[2], 31)):
        h ^= part
        h *= k
        np.right_shift(h, np.uint64(turn), out=part)
    h ^= part
    return h


#: The value of a bin without a hash.
_EMPTY = np.uint32(0xFFFFFFFF)


def band_keys(hashes: np.ndarray, starts: np.ndarray, bands: int, width: int, kind: int = 0, over: int = 0, spare: np.ndarray | None = None) -> np.ndarray:
    """MinHash keys (sets, bands) of runs of spread hashes (uint64) that begin at `starts`; every run has a hash at least.

    over: the last hashes of each run that don't count; the last run's are not there. spare: as long as hashes, written over.

    One hash a member: it falls into one of bands * width bins, and a bin keeps its least value; an empty bin takes the value
    of another one in an order that is the same for all sets. Two sets of Jaccard similarity j agree on a band in about j ** width of cases."""
    bins, ends = bands * width, np.append(starts[1:], len(hashes) + over)
    at = np.right_shift(hashes, np.uint64(32), out=spare)
    at *= np.uint64(bins)
    at >>= np.uint64(32)
    at = at.view(np.int64)
    at += np.repeat(np.arange(0, len(starts) * bins, bins), ends - starts)[: len(at)]
    out = (ends[:, None] - np.arange(1, over + 1)).ravel()
    at[out[out < len(at)]] = len(starts) * bins
    least = np.full(len(starts) * bins + 1, _EMPTY)
    np.minimum.at(least, at, hashes.astype(np.uint32))
    least = least[:-1].reshape(-1, bins)
    given = least.copy()
    for turn in np.random.default_rng(42).integers(0, bins, (64, bins)):
        holes = np.flatnonzero((least == _EMPTY).any(axis=1))
        if not len(holes):
            break
        some = least[holes]
        least[holes] = np.where(some == _EMPTY, given[holes][:, turn], some)
    least = np.where(least == _EMPTY, given.min(axis=1)[:, None], least).reshape(-1, bands, width)
    key = np.zeros(least.shape[:2], dtype=np.uint64)
    for k in range(width):
        key = mixed_here(key + least[:, :, k] + _MIX[0])
    return ((key >> np.uint64(32)) | (np.uint64(kind << 8) + np.arange(bands, dtype=np.uint64)) << np.uint64(32)).view(np.int64)


class Meet:
    """Every two rows of a bucket."""

    def __call__(self, rows: pd.DataFrame):
        return lambda x, y: np.ones(len(x), dtype=bool)


def shared_keys(rows: DataFrame) -> Saved:
    """(id, bucket) for each of a row's `keys` that another id has too. rows: id (once each) and keys (array<long>)."""
    one = rows.select("id", F.explode("keys").alias("bucket"))
    met = bucket_links(one, Meet())
    some = Saved(met.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    few = Saved(rows.join(some.df.hint("merge"), "id").select("id", F.explode("keys").alias("bucket")))
    some.drop()
    often = few.df.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    out = Saved(few.df.join(often.hint("merge"), "bucket").select("id", "bucket"))
    few.drop()
    return out


def find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def flatten(parent: np.ndarray) -> np.ndarray:
    """Every node points at its root."""
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def block_masks(blocks: int, differ: int) -> list[int]:
    """Masks of 64 bits: fingerprints with at most `differ` unequal bits agree under one of them at least.

    The bits fall into `blocks` runs; unequal bits spoil `differ` of them at most, so some choice of the others is equal."""
    ends = [round(i * 64 / blocks) for i in range(blocks + 1)]
    runs = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(ends, ends[1:], strict=False)]
    return [sum(c) for c in combinations(runs, blocks - differ)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def in_blocks(rows: DataFrame, blocks: int, differ: int) -> DataFrame:
    """rows once for each mask, with its number."""
    return rows.select("*", F.explode(F.array(*[F.lit(k).cast("short") for k in range(len(block_masks(blocks, differ)))])).alias("mask"))


def block_bucket(fingerprint: str, blocks: int, differ: int) -> Column:
    """Equal for fingerprints that agree under the mask of their row."""
    masks = F.array(*[F.lit(signed(m)) for m in block_masks(blocks, differ)])
    return F.xxhash64("mask", F.col(fingerprint).bitwiseAND(F.element_at(masks, F.col("mask") + 1)))


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Signed 64-bit fingerprints of runs of hashes (uint64) that begin at `starts`: a bit set in over half of a run's hashes.

    Every run has a hash at least. Bits are counted in 8 words of 8 one-byte counters, so in pieces of at most 255 hashes."""
    out = np.empty(len(starts), dtype=np.int64)
    ends = np.append(starts[1:], len(hashes))
    for at in range(0, len(starts), 8192):
        lo, hi = starts[at : at + 8192], ends[at : at + 8192]
        pieces = -(-(hi - lo) // 255)
        run = np.repeat(np.arange(len(lo)), pieces)
        cut = lo[run] + 255 * (np.arange(len(run)) - (np.cumsum(pieces) - pieces)[run])
        counts = np.zeros((len(lo), 64), dtype=np.int64)
        for i in range(0, len(cut), 2048):
            own, end = cut[i : i + 2048], cut[i + 2048] if i + 2048 < len(cut) else hi[-1]
            lanes = np.unpackbits(hashes[own[0] : end].astype(">u8").view(np.uint8)).view(np.uint64).reshape(-1, 8)
            sums = np.add.reduceat(lanes, own - own[0], axis=0).view(np.uint8).reshape(-1, 64)
            np.add.at(counts, run[i : i + 2048], sums)
        over = 2 * counts > (hi - lo)[:, None]
        out[at : at + 8192] = np.packbits(over, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)
    return out

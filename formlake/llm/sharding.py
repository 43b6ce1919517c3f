"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

A row's place on the ring is a hash of its key; the next virtual node clockwise names its shard. A shard takes the rows of its
own arcs up to its bound; the rows beyond it go on clockwise to the first shard with room, so only the overflow moves.
With slack 0 the bounds add up to the number of rows and differ by one at most, so the counts do too (law "rows").

Only counts per arc (shards x virtual nodes, at most a few thousand rows) reach the driver, where the overflow is dealt;
rows then find their shard by their rank within the arc. Ranks come from groups of bounded size: cells of the ring, and
cells with many rows (one key may hold a third of all) are salted by row.

Edge cases: a null key hashes like the text "null"; null text has size 1 and checksum 0; repeated rows and equal texts are placed
one by one; an empty table gives no rows; further columns are kept, whatever their names, but for columns shard and slot, which are
replaced. Rows with equal places go by their key and contents, so the result doesn't depend on how the input is cut into files as
long as a cell's rows fit one group; equal rows are interchangeable.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlake.llm.common import Saved, shielded

BITS = 32


def spot(key: str) -> int:
    """Place on the ring: the first 32 bits of the MD5 of the key's text."""
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16)


def spot_column(key: Column) -> Column:
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of the virtual nodes, clockwise."""
    return sorted((spot(f"shard {s} node {v}"), s) for s in range(shards) for v in range(nodes))


def bounds(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard takes at most. slack 0: as even as can be, adding up to `rows`."""
    if slack:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def deal(counts: dict[int, int], nodes: list[tuple[int, int]], limit: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rank after the last, shard, first slot): who takes which rows of each arc."""
    free, used, out, over = list(limit), [0] * len(limit), [], []

    def give(arc: int, lo: int, hi: int, shard: int) -> None:
        out.append((arc, lo, hi, shard, used[shard]))
        used[shard] += hi - lo
        free[shard] -= hi - lo

    for arc, (_, shard) in enumerate(nodes):
        n = counts.get(arc, 0)
        take = min(n, free[shard])
        if take:
            give(arc, 0, take, shard)
        if n > take:
            over.append((arc, take, n))
    for arc, lo, n in over:
        step = arc
        while lo < n:
            step += 1
            shard = nodes[step % len(nodes)][1]
            if take := min(n - lo, free[shard]):
                give(arc, lo, lo + take, shard)
                lo += take
    return out


def place(rows: DataFrame, key: str, shards: int = 8, nodes: int = 64, slack: float = 0.0, cell_bits: int = 12, group_rows: int = 500_000) -> DataFrame:
    """rows with shard and slot (gapless from 0 in each shard). cell_bits: the ring is cut into 2 ** cell_bits cells."""
    spark = rows.sparkSession
    own = ring(shards, nodes)
    width = 1 << (BITS - cell_bits)
    places = [p for p, _ in own]
    cells = [(c, bisect_left(places, c * width), [p for p in places if c * width <= p < (c + 1) * width]) for c in range(1 << cell_bits)]
    cells = spark.createDataFrame(cells, "cell int, base int, inside array<long>")  # 2 ** cell_bits rows
    place_of = spot_column(F.col(f"`{key}`"))
    rows = rows.drop(*({"shard", "slot"} & set(rows.columns)))
    spots = rows.withColumn("ring place", place_of)
    rows, back = shielded(spots)
    back, rows = back[:-1], rows.withColumnRenamed(rows.columns[-1], "spot_")
    put = rows.withColumn("mid_", F.monotonically_increasing_id())
    put = put.withColumn("same_", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    put = put.withColumn("cell", F.floor(F.col("spot_") / width).cast("int")).join(F.broadcast(cells), "cell")
    arc = (F.col("base") + F.size(F.filter("inside", lambda p: p < F.col("spot_")))) % len(own)
    kept = Saved(put.withColumn("arc_", arc.cast("int")).withColumnRenamed("cell", "cell_").drop("base", "inside"))

    busy = kept.df.groupBy("arc_", "cell_").agg(F.count("*").alias("n_"))  # at most cells + virtual nodes rows
    salts = F.ceil(F.col("n_") / group_rows)
    salted = kept.df.join(F.broadcast(busy), ["arc_", "cell_"]).withColumn("salt_", F.pmod(F.xxhash64("mid_"), salts).cast("int")).drop("n_")
    group = ["arc_", "cell_", "salt_"]
    sizes = salted.groupBy(*group).agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy("arc_").orderBy("cell_", "salt_").rowsBetween(Window.unboundedPreceding, -1))
    sizes = Saved(sizes.withColumn("before_", F.coalesce(before, F.lit(0))))
    counts = {r["arc_"]: r["n"] for r in sizes.df.groupBy("arc_").agg(F.sum("n_").alias("n")).collect()}
    plan = deal(counts, own, bounds(sum(counts.values()), shards, slack))
    plan = spark.createDataFrame(plan, "arc_ int, lo_ long, hi_ long, shard int, first_ long")  # two rows an arc, plus one for each shard that fills up
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("spot_", "same_", "mid_")) - 1
    ranked = salted.withColumn("rank_", rank).join(sizes.df.drop("n_"), group).withColumn("rank_", F.col("rank_") + F.col("before_"))
    dealt = ranked.join(F.broadcast(plan), "arc_").where("rank_ >= lo_ and rank_ < hi_")
    return dealt.select(*back, "shard", (F.col("first_") + F.col("rank_") - F.col("lo_")).alias("slot"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return place(rows, "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Merkle fixity audit of archive replicas.

Records are hashed with their offset and length. Each archive's bytes are cut into ranges of `leaf_bytes`; a leaf hashes the records that
begin in its range, in order of offset, and each node above hashes its up to `fanout` children in order, up to one root
for each archive. Replicas are compared at the roots, and only children of differing nodes are compared further, down
to the leaves, whose records are then compared one by one.

A node is one group of at most `fanout` rows, and a leaf holds at most leaf_bytes / shortest record of them; equal (offset,
digest) rows of one replica are counted before they meet. Levels are written as they are built, and the walk down
joins a level with the few differing parents.

Edge cases: a null body is a record of no bytes, told apart from an empty one; records that stand in one replica alone are
"missing" or "extra"; an archive in one replica alone is reported record by record; repeated rows count; null archives or offsets form an
archive or a place of their own; empty replicas give no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formlake.llm.common import Saved


def records_with_offsets(pages: DataFrame, key: str = "page_id", archive_rows: int = 2000, bodies: bool = True) -> DataFrame:
    """archive, key, offset, length, digest, changed of page records laid end to end in order of key, `archive_rows` keys an archive.

    changed: the digest that the record has with one byte altered, for tests of an audit. bodies: the column body too; without it,
    bodies are hashed where they are read and go no further.
    A record is a WARC header (type, target, length) and the page's bytes. An archive's number is its range of keys and a part: null
    keys, or keys that repeat so often that a range holds far more rows than keys, are dealt over parts by row. Keys that repeat
    stand in the order of their digests."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    record = pages.select(F.col(key).alias("key"), F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("body"))
    spoilt = F.concat(F.substring("body", 1, 20), F.encode(F.lit("#"), "UTF-8"), F.expr("substring(body, 22, octet_length(body))"))
    record = record.select("key", F.octet_length("body").cast("long").alias("length"), F.sha2("body", 256).alias("digest"), F.sha2(spoilt, 256).alias("changed"), *(["body"] if bodies else []))
    span = F.coalesce(F.floor(F.col("key") / archive_rows), F.lit(-1)).cast("long")
    record = record.withColumn("span", span).withColumn("mid", F.monotonically_increasing_id())
    sizes = record.groupBy("span").agg(F.ceil(F.count("*") / (2 * archive_rows)).alias("parts"))
    slim = record.join(sizes, "span").select(
        F.concat_ws("-", F.col("span").cast("string"), F.pmod(F.xxhash64("digest", "mid"), "parts").cast("string")).alias("archive"),
        "key", "length", "digest", "changed", *(["body"] if bodies else []))
    before = F.sum("length").over(Window.partitionBy("archive").orderBy("key", "digest").rowsBetween(Window.unboundedPreceding, -1))
    return slim.withColumn("offset", F.coalesce(before, F.lit(0)))


def with_digests(records: DataFrame) -> DataFrame:
    """archive, offset, length, digest of records with a body."""
    digest = F.when(F.col("body").isNull(), F.lit("null")).otherwise(F.sha2("body", 256))
    return records.select("archive", "offset", F.octet_length("body").cast("long").alias("length"), digest.alias("digest"))


def leaves(records: DataFrame, leaf_bytes: int) -> DataFrame:
    """archive, node, offset, length, digest, times: hashed records, equal ones counted. records: with length and digest, or with body."""
    hashed = records.select("archive", "offset", "length", "digest") if "body" not in records.columns else with_digests(records)
    counted = hashed.groupBy("archive", "offset", "length", "digest").agg(F.count("*").alias("times"))
    return counted.withColumn("node", F.coalesce(F.floor(F.col("offset") / leaf_bytes), F.lit(-1)).cast("long"))


def tree(records: DataFrame, leaf_bytes: int = 1 << 18, fanout: int = 16, levels: int = 4) -> tuple[Saved, list[Saved]]:
    """The hashed records, and the levels from leaves (0) to the root; each level: archive, node, hash."""
    rows = Saved(leaves(records, leaf_bytes))
    parts = F.struct("offset", F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "digest", F.col("times").cast("string")).alias("part"))
    out = [Saved(rows.df.groupBy("archive", "node").agg(_joined_hash(parts)))]
    for level in range(1, levels + 1):
        up = F.when(F.col("node") < 0, F.lit(-1)).otherwise(F.floor(F.col("node") / fanout) if level < levels else F.lit(0)).cast("long")
        parts = F.struct("node", F.concat_ws(":", F.col("node").cast("string"), "hash").alias("part"))
        below = out[-1].df.withColumn("up", up).withColumn("part", parts)
        out.append(Saved(below.groupBy("archive", F.col("up").alias("node_")).agg(_joined_hash(F.col("part"))).withColumnRenamed("node_", "node")))
    return rows, out


def _joined_hash(parts):
    ordered = F.array_sort(F.collect_list(parts))
    return F.sha2(F.array_join(F.transform(ordered, lambda x: x["part"]), "|"), 256).alias("hash")


def audit(primary: DataFrame, replica: DataFrame, leaf_bytes: int = 1 << 18, fanout: int = 16, levels: int = 4) -> tuple[DataFrame, DataFrame]:
    """(damage, archives). damage: archive, offset, status (corrupt, missing, extra), digests of both replicas.
    archives: archive, roots of both replicas, intact."""
    (rows_a, tree_a), (rows_b, tree_b) = (tree(x, leaf_bytes, fanout, levels) for x in (primary, replica))
    key = ["archive", "node"]
    suspect, archives = None, None
    for level in range(levels, -1, -1):
        a, b = (t[level].df.withColumnRenamed("hash", f"hash_{k}") for t, k in ((tree_a, "a"), (tree_b, "b")))
        if suspect is not None:
            up = F.when(F.col("node") < 0, F.lit(-1)).otherwise(F.floor(F.col("node") / fanout) if level < levels - 1 else F.lit(0)).cast("long")
            a, b = (_under(x, suspect.df, up) for x in (a, b))
        both = _full(a, b, key)
        if level == levels:
            archives = Saved(both.groupBy("archive").agg(
                F.sha2(F.array_join(F.array_sort(F.collect_list("hash_a")), "|"), 256).alias("root"),
                F.sha2(F.array_join(F.array_sort(F.collect_list("hash_b")), "|"), 256).alias("replica_root"),
                F.min(F.col("hash_a").eqNullSafe(F.col("hash_b"))).alias("intact")))
        after = Saved(both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select(*key))
        if suspect is not None:
            suspect.drop()
        suspect = after
    a, b = (r.df.select("archive", "node", "offset", "times", "length", "digest").join(suspect.df.select(F.col("archive").alias("sa"), F.col("node").alias("sn")), F.col("archive").eqNullSafe(F.col("sa")) & (F.col("node") == F.col("sn")), "left_semi") for r in (rows_a, rows_b))
    print_ = F.sort_array(F.collect_list(F.concat_ws(":", F.col("length").cast("string"), "digest", F.col("times").cast("string"))))
    a, b = (x.groupBy("archive", "offset").agg(F.array_join(print_, ",").alias(f"record_{k}")) for x, k in ((a, "a"), (b, "b")))
    both = _full(a, b, ["archive", "offset"])
    status = F.when(F.col("record_b").isNull(), "missing").when(F.col("record_a").isNull(), "extra").otherwise("corrupt")
    damage = both.where(~F.col("record_a").eqNullSafe(F.col("record_b"))).select("archive", "offset", status.alias("status"), F.col("record_a").alias("record"), F.col("record_b").alias("replica_record"))
    return damage, archives.df


def _under(level: DataFrame, suspect: DataFrame, up) -> DataFrame:
    """The nodes of a level whose parents differ."""
    parents = suspect.select(F.col("archive").alias("pa"), F.col("node").alias("pn"))
    return level.join(parents, F.col("archive").eqNullSafe(F.col("pa")) & (up == F.col("pn")), "left_semi")


def _full(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both sides by key, nulls of the key equal."""
    value_a, value_b = ([c for c in x.columns if c not in key] for x in (a, b))
    rows = a.select(*key, *value_a, *[F.lit(None).cast("string").alias(c) for c in value_b]).unionByName(b.select(*key, *[F.lit(None).cast("string").alias(c) for c in value_a], *value_b))
    return rows.groupBy(*key).agg(*[F.max(c).alias(c) for c in (*value_a, *value_b)])


def damaged_copy(records: DataFrame, every: int = 97) -> DataFrame:
    """A replica with known damage: of the records whose key's hash falls on `every`, in turn one byte is changed, the
    record is gone, or an empty one stands there. The other records keep their offsets."""
    sum_ = F.conv(F.substring(F.md5(F.coalesce(F.col("key").cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("long")
    hit, kind = sum_ % every == 0, F.floor(sum_ / every) % 3
    digest = F.when(hit & (kind == 0), F.col("changed")).when(hit & (kind == 2), F.sha2(F.encode(F.lit(""), "UTF-8"), 256)).otherwise(F.col("digest"))
    length = F.when(hit & (kind == 2), F.lit(0).cast("long")).otherwise(F.col("length"))
    out = records.where(~(hit & (kind == 1))).withColumn("digest", digest).withColumn("length", length)
    if "body" not in records.columns:
        return out
    spoilt = F.concat(F.substring("body", 1, 20), F.encode(F.lit("#"), "UTF-8"), F.expr("substring(body, 22, octet_length(body))"))
    return out.withColumn("body", F.when(hit & (kind == 0), spoilt).when(hit & (kind == 2), F.encode(F.lit(""), "UTF-8")).otherwise(F.col("body")))


def op3_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """Damaged records of the replica of all pages made by `damaged_copy`: archive, offset, status, both records' length, digest and number."""
    records = Saved(records_with_offsets(spark.read.parquet(f"{sf_dir}/pages.parquet"), bodies=False)).df
    damage, _ = audit(records, damaged_copy(records))
    return damage


#: For tables with no key that is null or repeats thousands of times (every archive in one part).
OP3_SQL = r"""
with raw as (
  select page_id, cast(page_id // 2000 as varchar) || '-0' as archive, ('0x' || substr(md5(cast(page_id as varchar)), 1, 8))::bigint as k,
    encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || 'Content-Length: ' || cast(octet_length(encode(coalesce(html, ''))) as varchar) || chr(13) || chr(10) || chr(13) || chr(10)
      || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) as body from pages),
rec as (
  select *, cast(coalesce(sum(octet_length(body)) over (partition by archive order by page_id, sha256(body) rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset"
  from raw),
pair as (
  select archive, "offset", k, cast(octet_length(body) as varchar) || ':' || sha256(body) || ':1' as record,
    case (k // 97) % 3 when 0 then cast(octet_length(body) as varchar) || ':' || sha256(body[1:20] || encode('#') || body[22:]) || ':1'
      when 2 then '0:' || sha256(encode('')) || ':1' end as replica_record
  from rec where k % 97 = 0)
select archive, "offset", case when replica_record is null then 'missing' else 'corrupt' end as status, record, replica_record from pair
"""

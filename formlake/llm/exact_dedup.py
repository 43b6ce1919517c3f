"""Exact deduplication by skew-safe combining, with DataFrame functions only.

Texts are equal when they are the same after every run of blanks (space, tab, line feed to carriage return) has become one space.
Copies are merged three times, each time by digest and whole text, so that no two different texts ever merge: within each task before
anything travels (the partial aggregation; a task has one salt), within each salted digest group, and over the salt winners. However many
copies a text has, a task of the second step reads one row of it for each task that has its salt, and a task of the third one row
for each salt. Digests under which more than one text was found are merged, and joined back, by their texts; under all others the
digest alone says which text a row has, so the join back to the rows carries no text. Groups that hold over a thousandth of all copies,
at most a thousand groups, are joined by broadcast, so that they needn't meet in one task.

Edge cases: a null text counts as an empty one; long texts are compared whole; a null doc_id comes after all others, and a group
without any doc_id has a null keep_id. Rows that repeat both text and doc_id are one document to `classes` and share its `kept`; `dedup` keeps one of
them (the least by its JSON form). An empty table gives an empty result; further columns are kept by `dedup`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.llm.common import BLANKS, Saved, shielded

#: Groups with more than this share of all copies are joined by broadcast: there are at most 1 / HOT of them.
HOT = 0.001


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _bodies(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """docs with the normalised text as `body` and its `digest`."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, " ")
    return docs.withColumn("body", body).withColumn("digest", digest(F.col("body")))


def _merged(bodies: DataFrame, salts: int) -> DataFrame:
    """(digest, body, keep, n) of each different text."""
    salted = bodies.select("digest", "body", "doc_id", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    winners = salted.groupBy("digest", "salt", "body").agg(F.min("doc_id").alias("keep"), F.count("*").alias("n"))
    return winners.groupBy("digest", "body").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))


def _labelled(bodies: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """bodies with keep and n of their group, null for a text that is there once. labels: the columns `by`, keep, n."""
    copies = labels.agg(F.sum("n")).first()[0] or 0
    hot = labels.where(F.col("n") > HOT * copies).select(*[F.col(c).alias(f"hot {c}") for c in by], F.struct("keep", "n").alias("hot"))
    rest = labels.where(F.col("n") <= HOT * copies).select(*[F.col(c).alias(f"own {c}") for c in by], F.struct("keep", "n").alias("own"))
    some = bodies.join(F.broadcast(hot), [bodies[c] == hot[f"hot {c}"] for c in by], "left").drop(*[f"hot {c}" for c in by])
    # rows that have found their group are spread over keys that no group has
    key = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("- "), F.xxhash64("doc_id").cast("string")))
    some = some.withColumn("key", key)
    on = [F.col("key" if c == "digest" else c) == F.col(f"own {c}") for c in by]
    rows = some.join(rest.hint("merge"), on, "left")
    return rows.select(*bodies.columns, F.coalesce("hot", "own").alias("group"))


def _grouped(docs: DataFrame, salts: int | None, digest: Callable[[Column], Column]) -> DataFrame:
    """docs (doc_id, text, ...) with body, digest, and group: struct of keep and n, null for a text that is there once."""
    spark = docs.sparkSession
    salts = salts or math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1
    bodies = _bodies(docs, digest)
    found = _merged(bodies, salts).groupBy("digest").agg(F.count("*").alias("texts"), F.min("keep").alias("keep"), F.sum("n").alias("n"))
    labels = Saved(found.where("n > 1")).df
    clashing = labels.where("texts > 1").select("digest")
    if clashing.isEmpty():
        return _labelled(bodies, labels, ["digest"])
    clear, mixed = bodies.join(clashing, "digest", "left_anti"), bodies.join(clashing, "digest", "left_semi")
    texts = Saved(_merged(mixed, salts).where("n > 1")).df
    both = _labelled(clear.select(*bodies.columns), labels.where("texts = 1"), ["digest"])
    return both.unionByName(_labelled(mixed.select(*bodies.columns), texts, ["digest", "body"]))


def _keep() -> Column:
    return F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("group.keep"))


def classes(docs: DataFrame, salts: int | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest of each row of docs (doc_id, text). salts: the square root of the shuffle partitions unless given."""
    rows = _grouped(docs.select("doc_id", "text"), salts, digest)
    size = F.coalesce("group.n", F.lit(1)).cast("long")
    return rows.select("doc_id", _keep().alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(_keep()).alias("kept"), "digest")


def dedup(docs: DataFrame, salts: int | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """docs with one row of each group of equal texts, columns as they are."""
    own, back = shielded(docs, "doc_id", "text")
    rows = _grouped(own, salts, digest).where(F.col("doc_id").eqNullSafe(_keep()))
    whole = F.struct(*[F.col(f"`{c}`") for c in own.columns])
    once = rows.where("group is null").select(*own.columns)
    first = rows.where("group is not null").groupBy("digest", "body").agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return once.unionByName(first).select(*back)


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("digest", "text_sha256")


OP13_SQL = r"""with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from d"""

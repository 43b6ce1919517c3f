"""Submitted against extracted fields: a join on keys in three tiers, a similarity by kind of field, and a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.functions.scratch import Table
from formlake.functions.similarity import similarity, strategy

MATCH, PARTIAL, KEY_LEAST = 0.9, 0.6, 0.7


#: Letters from rare to frequent; all others count as rarer still.
_RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate_"


def _prefix(text: Column) -> Column:
    """The rarest of a key's numbered letters: as many as it must share one of with every key that is alike.

    Keys of a and b letters with a ratio of KEY_LEAST or more have KEY_LEAST / 2 * (a + b) letters in common, so the shorter one has 7/13 of the
    longer one's letters, and of either's letters, in one order for all keys, the first a - 7/13 * a + 1 hold a common one."""
    letters = F.array_sort(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.struct(F.instr(F.lit(_RARE_FIRST), F.lower(c)).alias("place"), c.alias("c"))))
    numbered = F.transform(letters, lambda x, i: F.concat(x["c"], (i - F.array_position(letters, x)).cast("string")))
    share = KEY_LEAST / (2 - KEY_LEAST)
    return F.slice(numbered, 1, F.floor(F.size(letters) - F.ceil(F.size(letters) * share - 1e-9) + 1).cast("int"))


def alike_keys(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """(doc_id, field, key, score) of a document's wanted fields and its keys with a ratio of KEY_LEAST or more.

    Fields and keys of a document meet at equal letters of their prefixes and in the bounds of length; the prefix of each distinct text is worked out and
    each distinct pair of texts is scored once, however many documents hold it."""

    def lettered(rows: DataFrame, name: str) -> DataFrame:
        known = rows.select(name).distinct().select(name, F.array_distinct(_prefix(F.col(name))).alias("letters"))
        # outer: of a plain explode Spark infers a filter on the prefix, which it then works out for every row of the input
        return rows.join(known, name).select("doc_id", name, F.explode_outer("letters").alias("letter"))

    fields = lettered(wanted, "field")
    keys = lettered(have.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"), "key")
    share = KEY_LEAST / (2 - KEY_LEAST) - 1e-9
    a, b = F.length("field"), F.length("key")
    met = fields.join(keys, ["doc_id", "letter"]).where((a >= b * share) & (b >= a * share)).select("doc_id", "field", "key").distinct()
    pairs = met.select("field", "key").distinct().withColumn("score", similarity(F.lit("ratio"), "field", "key")).where(F.col("score") >= KEY_LEAST)
    return met.join(pairs, ["field", "key"])


def resolve_keys(submitted: DataFrame, extracted: DataFrame, fuzzy: bool = True) -> DataFrame:
    """submitted with key, extracted value and tier: equal keys (1), equal but for case (2, the last of several), alike keys (3), none.

    submitted: doc_id, field, submitted. extracted: doc_id, field, value, and ord if several keys differ by case only."""
    if fuzzy:  # both are read by every tier
        submitted, extracted = Table(submitted).df, Table(extracted).df
    order = F.col("ord") if "ord" in extracted.columns else F.col("field")
    have = extracted.select("doc_id", F.col("field").alias("key"), F.col("value").alias("extracted"), order.alias("ord"))
    exact = have.select("doc_id", F.col("key").alias("field"), F.col("key").alias("key1"), F.col("extracted").alias("value1"))
    lower = have.groupBy("doc_id", F.lower("key").alias("low")).agg(F.max_by(F.struct("key", "extracted"), "ord").alias("two"))
    rows = submitted.join(exact, ["doc_id", "field"], "left").withColumn("low", F.lower("field")).join(lower, ["doc_id", "low"], "left").drop("low")
    tier = F.when(F.col("key1").isNotNull(), 1).when(F.col("two").isNotNull(), 2)
    rows = rows.select(*submitted.columns, tier.alias("tier"), F.coalesce("key1", "two.key").alias("key"), F.when(F.col("key1").isNotNull(), F.col("value1")).otherwise(F.col("two.extracted")).alias("extracted"))
    if not fuzzy:
        return rows
    # only fields without a key yet go through the Python function, against the keys of their own document
    open_ = Table(rows.where("tier is null").select("doc_id", "field").distinct()).df
    scored = alike_keys(open_, have.select("doc_id", "key").distinct()).join(have, ["doc_id", "key"])
    best = scored.groupBy("doc_id", "field").agg(F.max_by(F.struct("key", "extracted"), F.struct("score", "key")).alias("three"))
    rows = rows.join(best, ["doc_id", "field"], "left")
    return rows.select(
        *submitted.columns, F.coalesce("tier", F.when(F.col("three").isNotNull(), 3)).alias("tier"),
        F.coalesce("key", "three.key").alias("key"), F.coalesce("extracted", "three.extracted").alias("extracted"))


def status(score: Column, found: Column) -> Column:
    return F.when(~found, "not_found").when(score >= MATCH, "match").when(score >= PARTIAL, "partial").otherwise("mismatch")


def verify(submitted: DataFrame, extracted: DataFrame, fuzzy: bool = True) -> DataFrame:
    """doc_id, field, submitted, extracted, similarity, status; fields without a key score 0."""
    rows = resolve_keys(submitted, extracted, fuzzy)
    kind = strategy(F.col("field")) if fuzzy else F.lit("gestalt")
    found = rows.where("tier is not null").withColumn("similarity", F.coalesce(similarity(kind, "submitted", "extracted"), F.lit(0.0)))
    lost = rows.where("tier is null").withColumn("similarity", F.lit(0.0).cast("double"))
    rows = found.unionByName(lost)
    return rows.select("doc_id", "field", "submitted", "extracted", "similarity", status(F.col("similarity"), F.col("tier").isNotNull()).alias("status"))


def overall(results: DataFrame) -> DataFrame:
    """Plain mean of similarities per document, zeros of missing fields included."""
    return results.groupBy("doc_id").agg(F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("overall_confidence"))


def response(results: DataFrame) -> DataFrame:
    """One row a document: overall confidence and the results in order of field."""
    rows = F.array_sort(F.collect_list(F.struct("field", "submitted", "extracted", "similarity", "status")))
    return results.groupBy("doc_id").agg(F.avg("similarity").alias("overall_confidence"), rows.alias("results"))


def parse_submitted(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, field, submitted) of JSON objects in fields_json, and the rows that hold none."""
    parsed = requests.withColumn("fields", F.from_json("fields_json", "map<string,string>"))
    good = parsed.where("fields is not null").select("doc_id", F.explode("fields").alias("field", "submitted"))
    return good, parsed.where("fields is null").drop("fields")

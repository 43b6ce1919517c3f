"""Field templates as data: one table for both matchers, with additions, learnt patterns, export, and JSON files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlake.functions import fixed
from formlake.functions.text import hits

SCHEMA = "registry string, name string, patterns array<string>, value_patterns array<string>, synonyms array<string>, required boolean, threshold double, version long"


def defaults(spark: SparkSession) -> DataFrame:
    """The built-in templates: registry "mapper" for whole texts, "matcher" for lines."""
    rows = [("mapper", k, p, [], s, False, 0.0, 0) for k, (p, s) in fixed.MAPPER_FIELDS.items()]
    rows += [("matcher", k, p, v, s, False, fixed.MATCHER_THRESHOLD, 0) for k, (p, v, s) in fixed.MATCHER_FIELDS.items()]
    return spark.createDataFrame(rows, SCHEMA)


def check(patterns: list[str], longest: int = 1000) -> list[str]:
    """The patterns, if each compiles, isn't overlong and has a group for the value."""
    for p in patterns:
        if len(p) > longest:
            raise ValueError("pattern too long")
        if re.compile(p).groups < 1:
            raise ValueError(f"pattern without a group: {p}")
    return patterns


def add(templates: DataFrame, registry: str, name: str, patterns: list[str], value_patterns: list[str] | None = None, synonyms: list[str] | None = None, version: int = 1) -> DataFrame:
    """templates with one more or one replaced template; a replaced one's synonyms stay valid as aliases."""
    row = templates.sparkSession.createDataFrame([(registry, name, patterns if registry == "matcher" else check(patterns), value_patterns or [], synonyms or [], False, fixed.MATCHER_THRESHOLD, version)], SCHEMA)
    return latest(templates.unionByName(row))


def latest(templates: DataFrame, as_of: int | None = None) -> DataFrame:
    """Of each registry and name the row of the highest version, or of the highest up to as_of."""
    templates = templates if as_of is None else templates.where(F.col("version") <= as_of)
    return templates.groupBy("registry", "name").agg(F.max_by(F.struct(*[F.col(c) for c in templates.columns]), "version").alias("t")).select("t.*")


def learn(templates: DataFrame, name: str, pattern: str, registry: str = "matcher") -> DataFrame:
    """templates with a pattern appended to a template (made if missing) unless it is there."""
    one = templates.sparkSession.createDataFrame([(registry, name, [], [], [], False, fixed.MATCHER_THRESHOLD, -1)], SCHEMA)
    grown = F.array_distinct(F.concat("patterns", F.array(F.lit(pattern))))
    hit = (F.col("registry") == registry) & (F.col("name") == name)
    return latest(templates.unionByName(one)).withColumn("patterns", F.when(hit, grown).otherwise(F.col("patterns")))


def add_document_type(templates: DataFrame, definitions: list[dict], version: int = 1) -> DataFrame:
    for d in definitions:
        templates = add(templates, "matcher", d["name"], d.get("patterns", []), d.get("value_patterns"), d.get("synonyms"), version)
    return templates


def aliases(templates: DataFrame) -> DataFrame:
    """alias (small letters) -> canonical field, of the line matcher; the later template wins."""
    rows = templates.where("registry = 'matcher'").select("name", "version", F.explode("synonyms").alias("alias"))
    return rows.groupBy(F.lower("alias").alias("alias")).agg(F.max_by("name", F.struct("version", "name")).alias("canonical"))


def schema_export(templates: DataFrame) -> DataFrame:
    """Per template: number of patterns, value patterns and synonyms, required; and how many templates there are."""
    return templates.select(
        "registry", "name", F.size("patterns").alias("n_patterns"), F.size("value_patterns").alias("n_value_patterns"), F.size("synonyms").alias("n_synonyms"),
        "required", F.count("*").over(Window.partitionBy("registry")).alias("n_templates"))


def save(templates: DataFrame, path: str) -> None:
    templates.write.mode("overwrite").json(path)


def load(templates: DataFrame, path: str) -> DataFrame:
    """templates with those of the file put in or over them; as they are if there is no such file."""
    at = templates.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(templates.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return templates
    found = templates.sparkSession.read.schema(SCHEMA).json(path)
    return latest(templates.unionByName(found.withColumn("version", F.col("version") + 1_000_000)))


def fields(templates: DataFrame, registry: str = "matcher", most: int = 2000) -> dict[str, tuple]:
    """The latest templates as the matchers take them: name -> (patterns, value patterns, synonyms, threshold), in order of name.

    They become part of the plan, so their number is bounded: with more than `most` this is an error."""
    rows = latest(templates.where(F.col("registry") == registry)).orderBy("name").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} templates")
    return {r["name"]: (r["patterns"], r["value_patterns"] or [], r["synonyms"] or [], r["threshold"]) for r in rows}


def match(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """match_lines of docs (doc_id, text) by the line matcher's templates as they stand in the table, each with its own threshold.

    Added, learnt and loaded templates count like the built-in ones; one without patterns finds nothing; an empty table gives no rows."""
    from formlake.operators.extract import match_lines

    own = {k: v for k, v in fields(templates).items() if v[0]}
    if not own:
        return match_lines(docs).limit(0)
    found = match_lines(docs, {k: v[:3] for k, v in own.items()}, 0.0)
    least = F.lit(None).cast("double")
    for k, v in own.items():
        least = F.when(F.col("field") == k, F.lit(float(v[3]))).otherwise(least)
    return found.where(F.col("confidence") >= least)


def synonym_hits(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(registry, name, n_docs): in how many texts a template's synonym stands, in small letters; templates found nowhere have 0.

    The templates go along as one array of the plan; every text is read once and yields a row a template found."""
    terms = F.struct("registry", "name", F.transform("synonyms", lambda s: F.lower(s)).alias("synonyms"))
    array = templates.agg(F.collect_list(terms).alias("t")).scalar()
    rows = docs.select(F.lower("text").alias("low"), array.alias("t"))
    hit = F.filter("t", lambda t: F.exists(t["synonyms"], lambda s: F.col("low").contains(s)))
    counts = rows.select(F.inline(hit)).groupBy("registry", "name").agg(F.count("*").alias("n"))
    named = templates.select("registry", "name")
    return named.join(counts, ["registry", "name"], "left").select("registry", "name", F.coalesce("n", F.lit(0)).alias("n_docs"))


def available(text: Column, field: str, patterns: list[str], synonyms: list[str]) -> Column:
    """Whether any pattern hits the lower-cased text, or any synonym stands in it."""
    low = F.lower(text)
    out = F.lit(False)
    for p in patterns:
        out = out | hits(low, p)
    for s in synonyms:
        out = out | low.contains(s.lower())
    return out

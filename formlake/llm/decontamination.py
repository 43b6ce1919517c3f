"""Benchmark decontamination with a broadcast set of normalised test n-grams (DataFrame functions only).

Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased. Each benchmark item
gives its windows of `n` words, an item of fewer words (but not none) one window of all its words. The set of window
hashes travels with the plan as a hashed literal set; every window of every document is looked up in it, hits are
verified against the set of window texts, and words inside verified windows are hit. The set's size is checked: beyond
`literal_limit` windows the set is a table, and the look-up a join of 8-byte window hashes that Spark broadcasts or shuffles by
size; only windows whose hash is in it are spelt and compared. The rows are the same.

Edge cases: null and empty texts have no words, so no hits; null items and items without words have no windows;
an item_id null hits words but is no item in the list; repeated rows each get their row; an empty benchmark leaves
all documents clean; overlapping and repeated windows count each word once; further columns are kept by
`decontaminate` and ignored by `report`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.llm.common import Saved, folded, shielded, words_of

#: Whatever is neither a letter or digit of ASCII nor beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD, GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]*"


def item_words(text: Column) -> Column:
    return words_of(folded(text), BETWEEN)


def grams_of(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(item_id, len, h, gram) of each window of each item; the gram is its words joined by blanks."""
    w = benchmark.select("item_id", item_words(F.col("text")).alias("w")).where("size(w) > 0")
    size = F.least(F.size("w"), F.lit(n))
    return (
        w.select("item_id", "w", size.alias("len"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("i"))
        .select("item_id", "len", F.slice("w", F.col("i"), F.col("len")).alias("s"))
        .select("item_id", "len", F.xxhash64("s").alias("h"), F.array_join("s", " ").alias("gram"))
    )


def _windows(length: int) -> Column:
    """Start positions of the windows of `length` words of column w; none if it has fewer words."""
    last = F.size("w") - length + 1
    return F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def mark(docs: DataFrame, benchmark: DataFrame, n: int = 10, literal_limit: int = 20_000) -> DataFrame:
    """docs with w (the words) and hits: array of (pos from 1, len, gram) of verified windows in order."""
    grams = grams_of(benchmark, n).select("len", "h", "gram").distinct()
    some = grams.limit(literal_limit + 1).collect()  # bounded
    worded = docs.withColumn("w", item_words(F.col("text")))
    none = F.array().cast("array<struct<pos:int,len:int,gram:string>>")
    if not some:
        return worded.withColumn("hits", none)
    if len(some) > literal_limit:
        return _mark_by_join(worded, grams)
    by_length: dict[int, list] = {}
    for r in some:
        by_length.setdefault(r["len"], []).append(r)
    found = [_found(length, own) for length, own in sorted(by_length.items())]
    return worded.withColumn("hits", F.array_sort(F.concat(*found)) if len(found) > 1 else found[0])


def _found(length: int, grams: list) -> Column:
    """Windows of `length` words whose hash is in the set, then whose text is."""
    hashes, texts = [r["h"] for r in grams], [r["gram"] for r in grams]
    seen = F.filter(_windows(length), lambda i: F.xxhash64(F.slice("w", i, F.lit(length))).isin(hashes))
    spelt = F.transform(seen, lambda i: _hit(i, length))
    return F.filter(spelt, lambda x: x["gram"].isin(texts))


def _hit(i: Column, length: int | Column) -> Column:
    size = F.lit(length) if isinstance(length, int) else length
    return F.struct(i.alias("pos"), size.alias("len"), F.array_join(F.slice("w", i, size), " ").alias("gram"))


def _mark_by_join(worded: DataFrame, grams: DataFrame) -> DataFrame:
    """The same for a benchmark with more windows than a literal set should hold: window hashes are joined, then only what they hit is spelt and compared."""
    rows = Saved(worded.withColumn("rid_", F.monotonically_increasing_id()))
    lengths = [r["len"] for r in grams.select("len").distinct().collect()]  # 1 to n
    each = rows.df.select("rid_", F.explode(F.concat(*[_hashed(k) for k in lengths])).alias("at")).select("rid_", "at.*")
    near = each.join(grams.select("len", "h").distinct(), ["len", "h"], "left_semi")
    near = near.groupBy("rid_").agg(F.collect_list(F.struct("pos", "len")).alias("near"))
    spelt = F.transform("near", lambda x: _hit(x["pos"], x["len"]))
    each = rows.df.select("rid_", "w").join(near, "rid_").select("rid_", F.explode(spelt).alias("hit"))
    found = each.join(grams.select("len", "gram"), (F.col("hit.gram") == F.col("gram")) & (F.col("hit.len") == F.col("len")), "left_semi")
    hits = found.groupBy("rid_").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    none = F.array().cast("array<struct<pos:int,len:int,gram:string>>")
    return rows.df.join(hits, "rid_", "left").withColumn("hits", F.coalesce("hits", none)).drop("rid_")


def _hashed(length: int) -> Column:
    return F.transform(_windows(length), lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"), F.xxhash64(F.slice("w", i, F.lit(length))).alias("h")))


def covered(hits: Column) -> Column:
    """Disjoint (lo, hi) word ranges, hi excluded, that the hits cover, each hit giving what the ones before left."""
    start = F.struct(F.lit(1).alias("end"), F.array().cast("array<struct<lo:int,hi:int>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        lo, hi = F.greatest(acc["end"], x["pos"]), x["pos"] + x["len"]
        return F.struct(
            F.greatest(acc["end"], hi).alias("end"),
            F.when(hi > lo, F.concat(acc["out"], F.array(F.struct(lo.alias("lo"), hi.alias("hi"))))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(hits, start, add, lambda acc: acc["out"])


def n_covered(hits: Column) -> Column:
    """How many words the hits cover."""
    start = F.struct(F.lit(1).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, x: Column) -> Column:
        hi = x["pos"] + x["len"]
        return F.struct(F.greatest(acc["end"], hi).alias("end"), (acc["n"] + F.greatest(hi - F.greatest(acc["end"], x["pos"]), F.lit(0))).alias("n"))

    return F.aggregate(hits, start, add, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, literal_limit: int = 20_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted item ids as strings), contaminated."""
    marked = mark(docs.select("doc_id", "text"), benchmark, n, literal_limit)
    rows = Saved(marked.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("w").cast("long").alias("n_words"),
        n_covered(F.col("hits")).alias("n_hit"), F.array_distinct(F.transform("hits", lambda x: x["gram"])).alias("grams"),
    ))
    owners = grams_of(benchmark, n).where("item_id is not null").select("gram", F.col("item_id").cast("string").alias("item")).distinct()
    items = rows.df.select("rid", F.explode("grams").alias("gram")).join(owners, "gram").groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return rows.df.join(items, "rid", "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "spans", n: int = 10) -> DataFrame:
    """docs without contaminated rows (mode "documents") or without the hit words and what follows each up to the
    next word (mode "spans"); clean rows stay as they are, and all columns are kept (n_chars follows the text)."""
    renamed, back = shielded(docs, "text", "n_chars")
    marked = mark(renamed, benchmark, n)
    if mode == "documents":
        kept = marked.where(F.size("hits") == 0)
    else:
        pieces = F.regexp_extract_all("text", F.lit(f"{WORD}{GAP}"), F.lit(0))
        ranges = covered(F.col("hits"))
        left = F.filter(F.transform("pieces", lambda p, i: F.struct(p.alias("p"), (i + 1).alias("i"))), lambda x: ~F.exists("ranges", lambda r: (x["i"] >= r["lo"]) & (x["i"] < r["hi"])))
        cut = F.concat(F.regexp_extract("text", f"^({GAP})", 1), F.array_join(F.transform("left", lambda x: x["p"]), ""))
        is_hit = F.size("hits") > 0
        kept = (
            marked.withColumn("ranges", F.when(is_hit, ranges)).withColumn("pieces", F.when(is_hit, pieces))
            .withColumn("left", F.when(is_hit, left)).withColumn("text", F.when(is_hit, cut).otherwise(F.col("text")))
        )
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        kept = kept.withColumn("n_chars", F.when(F.size("hits") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return kept.select(*back)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = report(docs, benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
with item as (
  select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark),
gram as (
  select item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
  from item, unnest(range(1, len(w) - least(len(w), 10) + 2)) t(i) where len(w) > 0),
doc as (
  select row_number() over () as rid, doc_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), []) as w
  from documents),
spot as (
  select rid, i, n, array_to_string(w[i:i + n - 1], ' ') as g
  from doc, (select distinct n from gram) k, unnest(range(1, len(w) - n + 2)) t(i)),
hit as (select distinct rid, i, n, g from spot where g in (select g from gram)),
words as (select rid, count(distinct j) as n_hit from hit, unnest(range(i, i + n)) t(j) group by rid),
own as (select distinct rid, cast(item_id as varchar) as item from hit join gram using (g, n) where item_id is not null),
items as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as names from own group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join words using (rid) left join items using (rid)
"""

"""Collocations by suffix arrays of word ids.

A task cuts its texts into shards of up to `room` bytes, turns every shard's words into ids, and sorts the places of the shard by
prefix doubling in numpy: ranks of one word, then of two, four and so on words from each place, until they reach past the longest phrase.
In that order equal phrases stand together: neighbours' common prefixes (LCP), cut at the ends of pieces, part the order into intervals, and each
interval is a phrase of 1 to `longest` words with its count. Shards give (lang, words, count), which Spark merges by key. Everything after that,
cuts, scores, containment and ranks, is joins and aggregations over the phrases with `least` occurrences or more.

Words: A-Z becomes a-z, texts are cut at . , ; : ! ? and line feed to carriage return into pieces, and pieces at spaces and tabs into words;
phrases don't go over the ends of pieces. Everything is counted per lang, null as `und`.

A phrase of 2 to `longest` words with a >= `least` occurrences is a candidate. A cut after its first k words gives l and r, the occurrences of
both parts, and floor(1000000 * a * a / (l * r)); the cut with the lowest value counts, the smallest k among equals. Products are decimals of 38
digits: exact below 10 ** 15 occurrences. Candidates that lie inside a longer one with at least `inside` percent of their own occurrences go.

Edge cases: null and empty texts have no words; texts over `room` are cut between pieces (a piece without an end is held whole); equal scores go by
count, then by phrase in order of UTF-8 bytes; repeated rows count again; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlake.llm.common import Saved

#: Letters and marks of UTF-8 texts, byte by byte: capitals become small, a tab a space, and every end of a piece a full stop.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + 9 * b".")
SCALE = 1_000_000


def suffix_array(ids: np.ndarray, longest: int) -> np.ndarray:
    """The places of ids in order of the words from there on, `longest` of them at least, by prefix doubling."""
    rank, span = ids, 1
    if int(ids.max(initial=0)) >= 1 << 31:  # ranks of pairs must fit into 63 bits
        rank = np.unique(ids, return_inverse=True)[1]
    order = np.argsort(rank, kind="stable")
    while span < longest:
        after = np.zeros_like(rank)
        after[:-span] = rank[span:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
        span *= 2
    return order


def intervals(ids: np.ndarray, room: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: one place of every different phrase, and how often it stands there.

    room: how many words, itself included, follow a place in its piece (0 for the end of a piece)."""
    order = suffix_array(ids, longest)
    left, right = order[:-1], order[1:]
    same = np.ones(len(left), dtype=bool)
    lcp = np.zeros(len(left), dtype=np.int64)
    for k in range(longest):
        same &= (np.minimum(room[left], room[right]) > k)
        same[same] = ids[left[same] + k] == ids[right[same] + k]
        lcp += same
    for n in range(1, longest + 1):
        begin = np.append(True, lcp < n)
        first = np.flatnonzero(begin)
        count = np.diff(np.append(first, len(order)))
        fits = room[order[first]] >= n  # places with less room stand alone: they share fewer than n words with any other
        yield n, order[first[fits]], count[fits]


class _Shards:
    """Batches (lang, text) to (lang and phrase with a line feed between, count)."""

    def __init__(self, longest: int, room: int):
        self.longest, self.room = longest, room

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bytes]] = []
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for part in self.parts(text.translate(_BYTES)):
                    held.append((lang, part))
                    size += len(part)
                    if size >= self.room:
                        yield from self.counted(held)
                        held, size = [], 0
        if held:
            yield from self.counted(held)

    def parts(self, text: bytes) -> Iterator[bytes]:
        lo = 0
        while len(text) - lo > self.room:
            cut = text.rfind(b".", lo, lo + self.room)
            cut = cut if cut >= 0 else text.find(b".", lo + self.room)
            if cut < 0:
                break
            yield text[lo:cut]
            lo = cut + 1
        yield text[lo:]

    def counted(self, held: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        names, words, owner = [], [], []
        for name, parts in groupby(sorted(held, key=itemgetter(0)), key=itemgetter(0)):
            own = b" . ".join(part.replace(b".", b" . ") for _, part in parts).split()
            names.append(name)
            words += own
            words.append(b".")
            owner.append(len(own) + 1)
        coded = pa.array(words, pa.binary()).dictionary_encode()
        del words
        known, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        stop = pc.index_in(pa.scalar(b".", pa.binary()), known).as_py()
        end = np.flatnonzero(ids == stop)
        room = end[np.searchsorted(end, np.arange(len(ids)))] - np.arange(len(ids))
        lang = np.repeat(np.arange(len(names)), owner)
        ids = ids + lang * len(known)  # a word of another lang is another word
        for n, at, count in intervals(ids, room, self.longest):
            parts = [known.take(pa.array(ids[at + k] % len(known))) for k in range(n)]
            phrases = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
            langs = pa.array([name.encode() for name in names], pa.binary()).take(pa.array(lang[at]))
            keys = pc.binary_join_element_wise(langs, phrases, pa.scalar(b"\n", pa.binary()))
            for lo in range(0, len(at), 50_000):
                cut = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([keys[cut].view(pa.string()), pa.array(count[cut].astype(np.int64))], names=["key", "a"])


def phrase_counts(docs: DataFrame, longest: int = 3, room: int = 2 << 20) -> DataFrame:
    """(lang, size, phrase, a) of all phrases of 1 to `longest` words of docs (lang, text); phrase: the words with a space between."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text <> ''")
    found = texts.mapInArrow(_Shards(longest, room), "key string, a long")
    # lang and phrase travel as one string: no phrase has a line feed
    merged = found.groupBy("key").agg(F.sum("a").alias("a")).withColumn("phrase", F.substring_index("key", "\n", -1))
    lang = F.substring("key", F.lit(1), F.length("key") - F.length("phrase") - 1)
    return merged.select(lang.alias("lang"), (F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1).alias("size"), "phrase", "a")


def _words(phrase: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " ", -1), first, n), " ")


def collocations(docs: DataFrame, top: int = 2000, least: int = 10, inside: int = 50, longest: int = 3, room: int = 2 << 20, salts: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` candidates of each lang by score, count and phrase."""
    counts = Saved(phrase_counts(docs, longest, room).where((F.col("a") >= least) | (F.col("size") == 1))).df
    total = counts.where("size = 1").groupBy("lang").agg(F.sum("a").alias("n"))
    often = counts.where(F.col("a") >= least)
    found = often.where("size > 1")
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    # every cut of every candidate, and the occurrences of both parts
    cuts = found.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size")
    cuts = cuts.select("lang", "phrase", "a", "k", _words(F.col("phrase"), 1, F.col("k")).alias("head"), _words(F.col("phrase"), F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    part = often.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    both = cuts.join(part.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(part.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr(f"cast({SCALE} as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    least_cut = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    scored = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), least_cut.alias("c"))
    # the most frequent candidate around each shorter one
    around = found.where("size > 2").select("lang", "a", "size", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: _words(F.col("phrase"), i, n))))).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (whole("longer") * 100 < whole("a") * inside))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score", F.pmod(F.xxhash64("phrase"), F.lit(salts)).alias("salt"))
    # the best of each salt first, so that no task orders a whole lang
    few = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from t),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p),
g as (select lang, 1 as size, unnest(w) as phrase from w
  union all select lang, 2, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) from w
  union all select lang, 3, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from w),
f as (select lang, size, phrase, count(*) as a from g group by all),
n as (select lang, cast(sum(a) as bigint) as n from f where size = 1 group by lang),
c as (select lang, size, phrase, a, string_split(phrase, ' ') as w from f where size > 1 and a >= 10),
cut as (select lang, phrase, a, 1 as k, w[1] as head, array_to_string(w[2:], ' ') as tail from c union all select lang, phrase, a, 2, array_to_string(w[1:2], ' '), w[3] from c where size = 3),
s as (select cut.*, l.a as l, r.a as r, cast((1000000::hugeint * cut.a * cut.a) // (l.a::hugeint * r.a) as bigint) as score from cut join f l on l.lang = cut.lang and l.phrase = cut.head join f r on r.lang = cut.lang and r.phrase = cut.tail),
b as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as x from s) where x = 1),
o as (select lang, phrase, max(a) as longer from (select lang, a, array_to_string(w[1:2], ' ') as phrase from c where size = 3 union all select lang, a, array_to_string(w[2:3], ' ') from c where size = 3) group by all),
k as (select b.* from b left join o using (lang, phrase) where longer is null or 100 * longer < 50 * a)
select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from k) join n using (lang) where rank <= 2000"""

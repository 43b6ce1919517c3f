"""Alignment of two tokenizers' tokens by the bytes that they cover.

Python only tokenises. Both tokenizers end a token before a single blank between two words, so texts are cut there into units, each
distinct unit is encoded once, and what goes to Spark is a slab of documents (up to ROOM bytes of text, one document at least): of its
distinct units the token ids, the offsets where tokens end and the number of the token at each byte; of each document the numbers of its
units. The rest is Spark's higher-order functions. In a unit, `array_intersect` of the two arrays of ends gives the offsets where both
end a token; between two of these lies a group, a `sequence` from the token of its first byte to that of its last one on either side. Two
tokens that share bytes share one stretch without an end inside it, so a link is what covers the byte before each end of either side.
A document's groups and links are those of its units, one after the other.

A link's count is the number of documents that hold its pair of ids; the pairs are counted by an aggregation, and the documents' links,
written before, are joined with the counts: by broadcast up to BROADCAST pairs (counted first), else by a shuffle on the pair.

Tokenizer A (byte-level, a tokenizers JSON file) reads a space and the text; tokenizer B (a SentencePiece model) reads the text and
adds the space itself. Special tokens' strings inside a text are ordinary text.

Edge cases: texts that are null or empty, or whose tokens' joined bytes on either side differ from space + text, have no tokens: all
numbers are 0 and the groups' hash is ''. A long text without blanks is one unit; it takes some 50 bytes of memory for each of its own while it is
aligned. Rows that repeat a doc_id, or have none, each get their own row, and a pair in two such rows counts as two documents. An empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.llm.common import Saved
from formlake.llm.sentencepiece_codec import MARK, MODEL, _Ragged, spread

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
#: Pairs of ids up to which their counts are broadcast: 16 bytes each, 64 MB in all.
BROADCAST = 4_000_000
#: A pair of ids as one number.
WIDTH = 1 << 24
#: Bytes of text in a slab.
ROOM = 1 << 21


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


#: A blank between two letters or marks that aren't blank: neither tokenizer has a token with something before and after it.
CUT = re.compile(r"(?<=\S) (?=\S)")


class _Side:
    """A tokenizer: ids of units, and the bytes of each id."""

    def __init__(self, raw: list[bytes], encode: Callable[[list[str]], list[list[int]]]):
        self.encode, self.raw = encode, raw
        self.size = np.array([len(x) for x in raw], dtype=np.int64)

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


@cache
def byte_level(path: str) -> _Side:
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    letters = byte_of_letter()
    raw = [b""] * own.get_vocab_size()
    for token, i in own.get_vocab().items():
        raw[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def encode(units: list[str]) -> list[list[int]]:
        """Many units in one call, as words of one text; the ends of their bytes part the ids again."""
        if any(u[0].isspace() for u in units):
            return [x.ids for x in own.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        ids = own.encode_batch_fast([" " + " ".join(units)], add_special_tokens=False)[0].ids  # without places of letters
        ends = np.cumsum(side.size[ids])
        cut = np.searchsorted(ends, np.cumsum([1 + len(u.encode()) for u in units])) + 1
        return [ids[lo:hi] for lo, hi in zip([0, *cut.tolist()], cut.tolist(), strict=False)]

    side = _Side(raw, encode)
    return side


@cache
def pieces(path: str) -> _Side:
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = []
    for i in range(own.get_piece_size()):
        piece = own.id_to_piece(i)
        special = own.is_control(i) or own.is_unknown(i)
        if not own.is_byte(i) and MARK in piece.lstrip(MARK):
            raise ValueError(f"a piece goes over a word's end: {piece!r}")
        raw.append(bytes([int(piece[3:5], 16)]) if own.is_byte(i) else b"" if special else piece.replace(MARK, " ").encode())
    return _Side(raw, lambda texts: own.encode(texts, num_threads=1))


class _Units:
    """Ids of units on both sides; texts are cut into units at CUT, and each distinct unit is encoded once.

    Held until they take up `room` bytes, about."""

    def __init__(self, a: str, b: str, room: int = 48_000_000):
        self.sides, self.room = (byte_level(a), pieces(b)), room
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows, self.held = (_Ragged(np.int32), _Ragged(np.int32)), 0
        self.whole: list[bool] = []  # whether the tokens' bytes are the unit's

    def numbers(self, units: list[str]) -> list[int]:
        if self.held > self.room:
            self.clear()
        new = [u for u in dict.fromkeys(units) if u not in self.known]
        for lo in range(0, len(new), 2000):
            self.add(new[lo : lo + 2000])
        return list(map(self.known.__getitem__, units))

    def add(self, new: list[str]) -> None:
        raw = [b" " + u.encode() for u in new]
        size = np.array(list(map(len, raw)), dtype=np.int64)
        good = np.ones(len(new), dtype=bool)
        for side, rows in zip(self.sides, self.rows, strict=True):
            each = side.encode(new)
            count = np.array(list(map(len, each)), dtype=np.int64)
            flat = np.fromiter(chain.from_iterable(each), dtype=np.int32)
            rows.append(flat, count)
            made = np.bincount(np.repeat(np.arange(len(new)), count), weights=side.size[flat], minlength=len(new))
            if (made != size).any() or side.bytes_of(flat.tolist()) != b"".join(raw):
                good &= np.array([side.bytes_of(ids) == r for ids, r in zip(each, raw, strict=True)])
            self.held += 4 * len(flat)
        self.known.update(zip(new, range(len(self.whole), len(self.whole) + len(new)), strict=True))
        self.whole += good.tolist()
        self.held += int(size.sum()) + 150 * len(new)


@cache
def _units(a: str, b: str) -> _Units:
    """Kept by a worker from task to task."""
    return _Units(a, b)


def _lists(flat: np.ndarray, count: np.ndarray) -> pa.ListArray:
    offsets = np.append(0, np.cumsum(count)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class _Tokeniser:
    """Rows (doc_id, text) to slabs (units, docs)."""

    def __init__(self, a: str, b: str):
        self.a, self.b = a, b

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(self.a, self.b)
        for batch in batches:
            ids, texts = batch.columns
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < len(texts):
                hi, held = lo + 1, int(size[lo])
                while hi < len(texts) and held + size[hi] <= ROOM:
                    held, hi = held + int(size[hi]), hi + 1
                yield self.slab(units, ids.slice(lo, hi - lo), texts.slice(lo, hi - lo).to_pylist())
                lo = hi

    def slab(self, units: _Units, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        cut = [CUT.split(t) if t else [] for t in texts]
        count = np.array([len(c) for c in cut], dtype=np.int64)
        number = np.array(units.numbers(list(chain.from_iterable(cut))), dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), count)
        doubtful = ~np.array(units.whole, dtype=bool)[number]
        lost = [i for i in np.unique(owner[doubtful]).tolist() if not self.same(units, number[owner == i], texts[i])]
        if lost:
            number, count = number[~np.isin(owner, lost)], np.where(np.isin(np.arange(len(texts)), lost), 0, count)
        here, number = np.unique(number, return_inverse=True)
        columns = []
        for side, rows in zip(units.sides, units.rows, strict=True):
            n = rows.count[here]
            flat = rows.flat[spread(rows.start[here], n)]
            end, at = np.append(0, np.cumsum(side.size[flat])), np.cumsum(n) - n
            place = np.arange(len(flat)) - np.repeat(at, n)
            columns += [_lists(flat, n), _lists(end[1:] - np.repeat(end[at], n), n), _lists(np.repeat(place, side.size[flat]), end[at + n] - end[at])]
        dictionary = pa.StructArray.from_arrays(columns, ["a_ids", "a_ends", "a_of", "b_ids", "b_ends", "b_of"])
        docs = pa.StructArray.from_arrays([ids, _lists(number, count)], ["doc_id", "units"])
        return pa.RecordBatch.from_arrays([_one_list(dictionary), _one_list(docs)], names=["units", "docs"])

    @staticmethod
    def same(units: _Units, number: np.ndarray, text: str) -> bool:
        """Whether the joined bytes of both sides are space + text."""
        raw = b" " + text.encode()
        return all(side.bytes_of(rows.flat[spread(rows.start[number], rows.count[number])].tolist()) == raw for side, rows in zip(units.sides, units.rows, strict=True))


def tokenised(docs: DataFrame, a: str = BYTE_LEVEL, b: str = MODEL) -> DataFrame:
    """Slabs of docs (doc_id, text): units, an array of structs a_ids, a_ends, a_of, b_ids, b_ends, b_of (arrays of int); docs, an array of structs doc_id, units (places in the first array)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    units = "array<struct<" + ", ".join(f"{x}: array<int>" for x in ("a_ids", "a_ends", "a_of", "b_ids", "b_ends", "b_of")) + ">>"
    return docs.select("doc_id", "text").mapInArrow(_Tokeniser(a, b), f"units {units}, docs array<struct<doc_id: {kind}, units: array<int>>>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, also where body uses it within functions over arrays."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _group(r: Column, e: Column, i: Column) -> Column:
    """`a1,a2|b1`: the tokens of the group that ends at byte e, the i-th end of its unit."""
    u, begin = r["u"], F.coalesce(F.get(r["ends"], i - 1), F.lit(0))

    def side(of: str, names: str) -> tuple[Column, Column, Column]:
        lo, hi = F.get(u[of], begin), F.get(u[of], e - 1)
        return lo == hi, F.get(r[names], lo), F.array_join(F.transform(F.sequence(lo, hi), lambda k: F.get(r[names], k)), ",")

    one_a, a, many_a = side("a_of", "a")
    one_b, b, many_b = side("b_of", "b")
    return F.when(one_a & one_b, F.concat(a, F.lit("|"), b)).otherwise(F.concat(many_a, F.lit("|"), many_b))


def _measured(units: Column) -> Column:
    """array<struct<text, links, n_a, n_b, n_groups>> of units as `tokenised` gives them."""
    def prepared(u: Column) -> Column:
        return F.struct(u.alias("u"), F.array_intersect(u["a_ends"], u["b_ends"]).alias("ends"), u["a_ids"].cast("array<string>").alias("a"), u["b_ids"].cast("array<string>").alias("b"))

    def result(r: Column) -> Column:
        u = r["u"]
        text = F.array_join(F.transform(r["ends"], lambda e, i: _group(r, e, i)), ";")
        links = F.transform(F.array_union(u["a_ends"], u["b_ends"]), lambda e: F.get(u["a_ids"], F.get(u["a_of"], e - 1)).cast("long") * WIDTH + F.get(u["b_ids"], F.get(u["b_of"], e - 1)))
        return F.struct(text.alias("text"), links.alias("links"), F.size(u["a_ids"]).alias("n_a"), F.size(u["b_ids"]).alias("n_b"), F.size(r["ends"]).alias("n_groups"), (F.size(u["a_ids"]) + F.size(u["b_ids"]) - F.size(r["ends"])).alias("n_links"))

    return F.transform(F.transform(units, prepared), result)


def aligned(slabs: DataFrame, groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, links (array<long>: A's id * WIDTH + B's id), groups_sha256 of the documents of `tokenised` slabs.

    groups: with the hashed text `a1,a2|b1;a3|b2,b3` itself, as column groups."""
    def document(d: Column, units: Column) -> Column:
        total = lambda what: F.aggregate(d["units"], F.lit(0).cast("long"), lambda n, i: n + F.get(units, i)[what]).alias(what)
        text = F.array_join(F.transform(d["units"], lambda i: F.get(units, i)["text"]), ";")
        spelt = [text.alias("groups")] if groups else []
        links = F.flatten(F.transform(d["units"], lambda i: F.get(units, i)["links"]))
        return F.struct(d["doc_id"].alias("doc_id"), total("n_a"), total("n_b"), total("n_groups"), total("n_links"), links.alias("links"), F.when(F.size(d["units"]) > 0, F.sha2(text, 256)).otherwise("").alias("groups_sha256"), *spelt)

    return slabs.select(F.inline(_let(_measured(F.col("units")), lambda units: F.transform("docs", lambda d: document(d, units)))))


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows of `links` (array<long>) each pair of ids stands, and whether no other pair of its A id stands in more."""
    each = links.select(F.explode(F.array_distinct("links")).alias("pair"))
    counts = each.groupBy("pair").agg(F.count("*").alias("n"))
    top = counts.groupBy(F.expr(f"pair div {WIDTH}").alias("a")).agg(F.max("n").alias("top"))
    return counts.withColumn("a", F.expr(f"pair div {WIDTH}")).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, a: str = BYTE_LEVEL, b: str = MODEL, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs (doc_id, text)."""
    rows = aligned(tokenised(docs, a, b))
    kept = Saved(rows.withColumn("row", F.monotonically_increasing_id())).df  # the row numbers stand in the table, so they stay as they are
    counts = Saved(pair_counts(kept)).df
    known = F.broadcast(counts) if counts.count() <= broadcast else counts
    each = kept.where("n_links > 0").select("row", F.explode("links").alias("pair"))
    sums = each.join(known, "pair").groupBy("row").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum"))
    out = kept.drop("links").join(sums.hint("merge"), "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))

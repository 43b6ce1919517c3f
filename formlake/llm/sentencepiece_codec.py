"""SentencePiece encoding with seeded merge-dropout, and decoding.

A text gets the model's dummy leading blank, blanks become the mark U+2581, and it falls into units: a run of marks with what follows up
to the next mark. No piece of a merge-type vocabulary has a mark after another character (checked when the model is read),
so units are encoded by themselves. Each unit has an agenda of candidate merges, best rank first and leftmost among equals;
a popped candidate is skipped when the keyed hash of (seed, document, number of the unit in it, place, piece) falls under the
dropout share, so every occurrence of a word is cut by its own draws. Without dropout the pieces are those of the SentencePiece
library. Characters outside the vocabulary become byte pieces, and so does a U+2581 of the text itself: decoding gives back every text
exactly.

Each distinct unit goes once through its agenda without dropout, and its merges are kept. An occurrence whose draws skip none of
these merges has the same pieces; all others go through their agendas again, with their draws, many units side by side.

Edge cases: null has no pieces and decodes to null; an empty text has no pieces; very long words go through the same agenda
(n log n); repeated rows get equal pieces; an empty table gives an empty result; further columns are kept by `encode` and
`decode`, which refuse to overwrite a column that is there.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from formlake.llm.common import shielded

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Stands for a U+2581 that the text itself holds, while the text is cut into units: a code point no text in UTF-8 can have.
OWN_MARK = "\ud800"
MASK = (1 << 64) - 1
#: Odd multipliers of the hash table, the draws and the keys of occurrences.
HASH, BY_PLACE, BY_PIECE, STIR, BY_NUMBER = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0x94D049BB133111EB


class Vocabulary:
    """Pieces of a merge-type model: ids and ranks of ordinary pieces, ids of byte pieces, bytes of every id."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.ids: dict[str, int] = {}
        self.rank: list[float] = []
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.rank.append(-sp.get_score(i))
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"")
            else:
                self.ids[piece] = i
                self.raw.append(piece.replace(MARK, " ").encode())
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"a piece goes over a word's end: {piece!r}")
        self.size = len(self.raw)
        self.ranks = np.array(self.rank, dtype=np.float32)  # whole numbers under 2 ** 24
        self.of_char = np.full(0x110000, -1, dtype=np.int32)
        merges = {}
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    merges[a * self.size + b] = i
        self._table(merges)

    def _table(self, merges: dict[int, int]) -> None:
        """An open hash table of the merges, a power of two at least four times as large."""
        self.bits = max(8, (4 * len(merges)).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, dtype=np.int64)
        self.made = np.full(len(self.keys), -1, dtype=np.int32)
        for key, piece in sorted(merges.items()):
            at = ((key * HASH) & MASK) >> (64 - self.bits)
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.made[at] = key, piece

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two neighbouring pieces make, -1 for none."""
        shape, a, b = a.shape, a.ravel(), b.ravel()
        key = a.astype(np.int64) * self.size + b
        at = ((key.view(np.uint64) * np.uint64(HASH)) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[at]
        out = np.where(there == key, self.made[at], -1)
        more = np.flatnonzero((there != key) & (there >= 0))
        while len(more):
            at[more] += 1
            there = self.keys[at[more]]
            out[more] = np.where(there == key[more], self.made[at[more]], -1)
            more = more[(there != key[more]) & (there >= 0)]
        return np.where((np.minimum(a, b) >= 0) & (np.maximum(a, b) < self.size), out, -1).reshape(shape)


    def spelt(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows filled up with -1, and how many each has; characters outside the vocabulary (size + code point) as byte pieces."""
        there = rows >= 0
        flat, count = rows[there], there.sum(axis=1)
        if (flat < self.size).all():
            return flat, count
        code = np.where(flat == self.size + ord(OWN_MARK), ord(MARK), flat - self.size)
        n = np.where(flat < self.size, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        k = spread(np.zeros(len(n), dtype=np.int64), n)
        value, code, size = np.repeat(flat, n), np.repeat(code, n), np.repeat(n, n)
        tail = (code >> (6 * (size - 1 - k))) & 0x3F | 0x80
        head = np.where(size == 1, code, (code >> (6 * (size - 1))) | ((0xF00 >> size) & 0xFF))
        byte = np.where(k == 0, head, tail) & 0xFF
        owner = np.repeat(np.arange(len(rows)), count)
        return np.where(value < self.size, value, np.array(self.byte_ids)[byte]).astype(np.int32), np.bincount(owner, weights=n, minlength=len(rows)).astype(np.int64)


@cache
def vocabulary(model: str) -> Vocabulary:
    """Read once in each worker process."""
    return Vocabulary(model)


class _Ragged:
    """Rows of different lengths in one growing array."""

    def __init__(self, kind):
        self.flat, self.used = np.zeros(1 << 12, dtype=kind), 0
        self.start, self.count, self.rows = np.zeros(1 << 10, dtype=np.int64), np.zeros(1 << 10, dtype=np.int64), 0

    def append(self, flat: np.ndarray, count: np.ndarray) -> None:
        for name, used, more in (("flat", self.used, len(flat)), ("start", self.rows, len(count)), ("count", self.rows, len(count))):
            if used + more > len(getattr(self, name)):
                setattr(self, name, np.resize(getattr(self, name), 2 * (used + more)))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[self.rows : self.rows + len(count)] = self.used + np.cumsum(count) - count
        self.count[self.rows : self.rows + len(count)] = count
        self.used, self.rows = self.used + len(flat), self.rows + len(count)


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1 and so on for count[0] places, then from start[1]."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


class Codec:
    """room: bytes that the known units may take up, about."""

    def __init__(self, vocab: Vocabulary, dropout: float = 0.1, seed: int = 0, room: int = 32_000_000):
        self.vocab, self.room = vocab, room
        self.seed = np.uint64(xxhash.xxh64_intdigest(str(seed)))
        self.limit = int(dropout * (1 << 32))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.names: list[str] = []
        self.ids, self.draws = _Ragged(np.int32), _Ragged(np.uint64)

    def encode(self, text: str, key: int = 0) -> bytes:
        """Ids as 4-byte little-endian integers. key: the document's."""
        return self.encode_many([text], [key])[0]

    def encode_many(self, texts: list[str | None], keys: list[int]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            some, size = [], 0
            while at + len(some) < len(texts) and size < 100_000:
                t = texts[at + len(some)]
                t = MARK + (t.replace(MARK, OWN_MARK) if MARK in t else t).replace(" ", MARK) if t else ""
                some.append(UNIT.findall(t))
                size += len(some[-1])
            out += self._encode(some, np.array(keys[at : at + len(some)], dtype=np.uint64))
            at += len(some)
        return out

    def _encode(self, texts: list[list[str]], keys: np.ndarray) -> list[bytes]:
        if len(self.known) * 250 > self.room:  # a key, a number and a dozen small ones each
            self.forget()
        self.learn(list(set().union(*texts).difference(self.known)))
        many = np.array([len(t) for t in texts])
        row = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=many.sum())
        ids, count = self.ids, self.ids.count[row]
        changed = np.zeros(0, dtype=np.int64)
        if self.limit:
            salt = self.salt(np.repeat(keys, many), spread(np.zeros(len(many), dtype=np.int64), many))
            draws = self.draws.count[row]
            owner = np.repeat(np.arange(len(row)), draws)
            changed = np.unique(owner[self.skipped(self.draws.flat[spread(self.draws.start[row], draws)], salt[owner])])
            flat, fresh = self.agendas([self.names[r] for r in row[changed].tolist()], salt[changed])
            count[changed] = fresh
        whole = np.empty(count.sum(), dtype="<i4")
        same = np.ones(len(row), dtype=bool)
        same[changed] = False
        place = np.cumsum(count) - count
        whole[spread(place[same], count[same])] = ids.flat[spread(ids.start[row[same]], count[same])]
        if len(changed):
            whole[spread(place[changed], fresh)] = flat
        ends = np.cumsum(np.bincount(np.repeat(np.arange(len(many)), many), weights=count, minlength=len(many)).astype(np.int64))
        return [whole[lo:hi].tobytes() for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def salt(self, key: np.ndarray, number: np.ndarray) -> np.ndarray:
        """What the draws of an occurrence go by: the seed, the document's key, and the unit's number in it."""
        h = (self.seed ^ (key + np.uint64(1)) * np.uint64(HASH)) + number.astype(np.uint64) * np.uint64(BY_NUMBER)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(STIR)
        return h ^ (h >> np.uint64(32))

    def skipped(self, draw: np.ndarray, salt: np.ndarray) -> np.ndarray:
        h = (salt ^ draw) * np.uint64(STIR)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(STIR)
        return (h >> np.uint64(32)) < np.uint64(self.limit)

    def learn(self, units: list[str]) -> None:
        """Pieces and merges, both without dropout, of units not met before."""
        for u in units:
            self.known[u] = len(self.names)
            self.names.append(u)
        draws: list[tuple[np.ndarray, np.ndarray]] = []
        flat, count = self.agendas(units, None, draws)
        self.ids.append(flat, count)
        who, draw = (np.concatenate([d[i] for d in draws]) for i in (0, 1)) if draws else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))
        self.draws.append(draw[np.argsort(who, kind="stable")], np.bincount(who, minlength=len(units)))

    def units(self, units: list[str], salt: int) -> dict[str, bytes]:
        """Pieces of many units, all with the same draws."""
        flat, count = self.agendas(units, np.full(len(units), salt, dtype=np.uint64))
        ends = np.cumsum(count)
        return {u: flat[lo:hi].astype("<i4").tobytes() for u, lo, hi in zip(units, (ends - count).tolist(), ends.tolist(), strict=True)}

    def agendas(self, units: list[str], salt: np.ndarray | None, draws: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of many units, one after the other, and how many each has. salt: no dropout for None. draws: takes (unit, draw) of the merges."""
        size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        parts, count = [], np.zeros(len(units), dtype=np.int64)
        for width, least in ((8, 0), (16, 8), (32, 16)):
            every = np.flatnonzero((size > least) & (size <= width))
            for i in range(0, len(every), 16_384):
                at = every[i : i + 16_384]
                flat, count[at] = self.side_by_side([units[k] for k in at.tolist()], size[at], None if salt is None else salt[at], width, at, draws)
                parts.append((at, flat))
        for k in np.flatnonzero(size > 32).tolist():
            merges: list[tuple[int, int]] = []
            flat = np.array(self.unit(units[k], None if salt is None else int(salt[k]), merges), dtype=np.int32)
            count[k] = len(flat)
            parts.append((np.array([k]), flat))
            if draws is not None and merges:
                m = np.array(merges, dtype=np.uint64)
                draws.append((np.full(len(m), k), m[:, 0] * np.uint64(BY_PLACE) + m[:, 1] * np.uint64(BY_PIECE)))
        place, out = np.cumsum(count) - count, np.empty(count.sum(), dtype=np.int32)
        if parts:
            every = np.concatenate([at for at, _ in parts])
            out[spread(place[every], count[every])] = np.concatenate([flat for _, flat in parts])
        return out, count

    def side_by_side(self, units: list[str], size: np.ndarray, salt: np.ndarray | None, width: int, names: np.ndarray, draws: list | None) -> tuple[np.ndarray, np.ndarray]:
        """Agendas of short units, a merge each at a time: their pieces, one unit after the other, and how many each has."""
        vocab, n = self.vocab, len(units)
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        chars = vocab.of_char[code]
        chars = np.where(chars >= 0, chars, code.astype(np.int32) + vocab.size)  # outside the vocabulary: merges with nothing
        sym = np.full((n, width + 2), -1, dtype=np.int32)  # two places at the end stand for none
        sym[np.arange(width + 2)[None, :] < size[:, None]] = chars
        wide = width + 2
        made = np.full((n, wide), -1, dtype=np.int32)
        made[:, :-1] = vocab.merge(sym[:, :-1], sym[:, 1:])
        after = np.broadcast_to(np.arange(1, wide + 1, dtype=np.int32), (n, wide)).copy()
        after[:, -1] = wide - 1
        before = np.broadcast_to(np.arange(-1, wide - 1, dtype=np.int32), (n, wide)).copy()
        rank = self.judged(made, np.arange(wide)[None, :], None if salt is None else salt[:, None])
        sym, made, after, before = (x.ravel() for x in (sym, made, after, before))
        live = np.arange(n)
        while len(live):
            best = rank[live].argmin(axis=1)
            open_ = np.isfinite(rank[live, best])
            live, best = live[open_], best[open_]
            if not len(live):
                break
            row = live * wide
            i = row + best
            j = row + after[i]
            if draws is not None:
                draws.append((names[live], best.astype(np.uint64) * np.uint64(BY_PLACE) + made[i].astype(np.uint64) * np.uint64(BY_PIECE)))
            sym[i], sym[j] = made[i], -1
            k = row + after[j]
            after[i], before[k] = after[j], best
            flat = rank.reshape(-1)
            flat[j] = np.inf
            h = before[i]
            back = h >= 0
            h = row[back] + h[back]
            left, right = np.concatenate([i, h]), np.concatenate([k, i[back]])  # the merge has new neighbours
            piece = vocab.merge(sym[left], sym[right])
            made[left] = piece
            of = np.concatenate([live, live[back]])
            flat[left] = self.judged(piece, left - of * wide, None if salt is None else salt[of])
        return vocab.spelt(sym.reshape(n, wide))

    def judged(self, made: np.ndarray, place: np.ndarray, salt: np.ndarray | None) -> np.ndarray:
        """Ranks of candidate merges; infinite for none and for those that their draw skips."""
        rank = np.where(made >= 0, self.vocab.ranks[np.maximum(made, 0)], np.float32(np.inf))
        if salt is not None:
            draw = place.astype(np.uint64) * np.uint64(BY_PLACE) + made.astype(np.uint64) * np.uint64(BY_PIECE)
            rank[self.skipped(draw, salt)] = np.inf
        return rank

    def decode(self, ids: bytes) -> str:
        raw = self.vocab.raw
        out = b"".join(map(raw.__getitem__, np.frombuffer(ids, dtype="<i4").tolist()))
        return out[1:].decode("utf-8")

    def unit(self, text: str, salt: int | None = None, merges: list | None = None) -> list[int]:
        """Agenda merges of one unit. merges: takes their places and pieces."""
        ids, rank, limit = self.vocab.ids, self.vocab.rank, self.limit if salt is not None else 0
        sym = list(text)
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            k = ids.get(sym[i] + sym[j])
            if k is not None:
                heapq.heappush(agenda, (rank[k], i, k, len(sym[i]) + len(sym[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, k, size = heapq.heappop(agenda)
            j = right[i]
            if not sym[i] or j >= n or len(sym[i]) + len(sym[j]) != size:
                continue  # one side was merged with another meanwhile
            if limit:
                h = ((salt ^ ((i * BY_PLACE + k * BY_PIECE) & MASK)) * STIR) & MASK
                h = ((h ^ (h >> 32)) * STIR) & MASK
                if (h >> 32) < limit:
                    continue
            if merges is not None:
                merges.append((i, k))
            sym[i] += sym[j]
            sym[j] = ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
                offer(i, right[i])
            if left[i] >= 0:
                offer(left[i], i)
        out = []
        for s in sym:
            if s:
                k = ids.get(s)
                if k is not None:
                    out.append(k)
                else:
                    out += [self.vocab.byte_ids[b] for b in s.replace(OWN_MARK, MARK).encode("utf-8")]
        return out


_codecs: dict[tuple, Codec] = {}


def codec(model: str, dropout: float, seed: int) -> Codec:
    """The latest setting's codec stays in its worker process, so that units stay known from batch to batch."""
    key = (model, dropout, seed)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary(model), dropout, seed)
    return _codecs[key]


def document_key(text: str | None) -> int:
    return zlib.crc32(text.encode("utf-8")) if text else 0


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", model: str = MODEL, dropout: float = 0.1, seed: int = 0) -> DataFrame:
    """docs with the column `ids` (array of int; null for null)."""
    if ids in docs.columns:
        raise ValueError(f"there is a column {ids}")

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(model, dropout, seed)
        for b in batches:
            coded = own.encode_many(b.tolist(), list(map(document_key, b)))
            yield pd.Series([None if t is None else np.frombuffer(x, dtype="<i4") for t, x in zip(b, coded, strict=True)], dtype=object)

    return docs.withColumn(ids, run(F.col(f"`{text}`")))


def decode(coded: DataFrame, ids: str = "ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """coded with the column `text` that the ids stand for."""
    if text in coded.columns:
        raise ValueError(f"there is a column {text}")

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(model, 0.0, 0)
        for b in batches:
            yield pd.Series([None if x is None else own.decode(np.asarray(x, dtype="<i4").tobytes()) for x in b], dtype=object)

    return coded.withColumn(text, run(F.col(f"`{ids}`")))


class _Recode:
    def __init__(self, names: list[str], *setting):
        self.names, self.setting = names, setting

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(*self.setting)
        for b in batches:
            texts, pieces, sums = [], [], []
            given = b["text"].tolist()
            for i in range(0, len(given), 500):
                some = given[i : i + 500]
                for t, ids in zip(some, own.encode_many(some, list(map(document_key, some))), strict=True):
                    texts.append(own.decode(ids) if t else t)
                    pieces.append(len(ids) // 4)
                    sums.append(zlib.crc32(ids))
            yield b.assign(text=texts, **dict(zip(self.names, (pieces, sums), strict=True)))


def recode(docs: DataFrame, model: str = MODEL, dropout: float = 0.1, seed: int = 0) -> DataFrame:
    """docs with their texts encoded and decoded, n_pieces and ids_crc32; underscores follow these names where docs has such columns."""
    names = [next(n + "_" * k for k in range(len(docs.columns) + 1) if n + "_" * k not in docs.columns) for n in ("n_pieces", "ids_crc32")]
    named, back = shielded(docs, "text")
    schema = StructType([*named.schema.fields, *(StructField(n, LongType()) for n in names)])
    return named.mapInPandas(_Recode(names, model, dropout, seed), schema).select(*back, *names)


class _RoundTrip:
    """Encodes and decodes in one pass: number of pieces, checksum of the ids, digest of the decoded text."""

    def __init__(self, *setting):
        self.setting = setting

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(*self.setting)
        for b in batches:
            rows, texts = [], b["text"].tolist()
            raws = [None if t is None else t.encode("utf-8") for t in texts]
            for i in range(0, len(texts), 500):
                some = raws[i : i + 500]
                for raw, ids in zip(some, own.encode_many(texts[i : i + 500], [zlib.crc32(r or b"") for r in some]), strict=True):
                    if raw is None:
                        rows.append((0, 0, None, True))
                        continue
                    back = own.decode(ids).encode("utf-8")
                    rows.append((len(ids) // 4, zlib.crc32(ids), sha256(back).hexdigest(), back == raw))
            out = pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "decoded_sha256", "lossless"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out


def round_trip(docs: DataFrame, model: str = MODEL, dropout: float = 0.1, seed: int = 0) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256 (null for null), lossless."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean"
    return docs.select("doc_id", "text").mapInPandas(_RoundTrip(model, dropout, seed), schema)


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Toxicity by a subsequence string kernel: a support vector machine over Nyström landmarks, trained on labelled sentences.

The kernel compares two tokens by their common letter triples in order, gaps allowed; each triple weighs
DECAY ** span, and values are normalised to 1 for a token with itself. Marks that aren't letters take up room
in a gap but make no triple, so "i-d-i-o-t" and "idxiot" stay near "idiot". The machine works in the Nyström space
of landmark tokens; since the kernel is a sum over triples, its decision for a token is one look-up per triple.
A document's decision is that of its most toxic token; a logistic curve turns it into a score of 0 to 1.

Fit: labels belong to documents, each a bag of its sentences' tokens, so the machine learns from bags: a toxic bag's witness (its token of
the highest decision) should lie above the margin, a clean bag's highest token below it. Rounds alternate between fitting and
choosing witnesses; the first witnesses are each bag's least likely token for a clean one. Witnesses are learnt with a letter put in at each
of their places too, so that such spellings lie above the margin. Clean bags' highest tokens of all rounds stay as examples. Landmarks are drawn from the bags: witnesses, highest clean tokens, and others.
Bags are at most `max_per_class` labelled documents a class (the lowest hashes of doc_id; a documented bound); no token,
frequency or length is left out of them. The driver sees a token a bag and round.

Edge cases: null and empty texts have no token and get the score of the lowest decision; a token with under three
letters has no triple; very long tokens are read in overlapping pieces, whole; repeated rows each get their row;
an empty or one-class training table gives a constant score (the share of toxic labels, 0 if there are none);
further columns of the input don't matter. Documents with null doc_id are scored but never trained on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.llm.common import Saved

DECAY = 0.8
#: Letters of one piece of a very long token, and how far the next piece starts behind.
PIECE, STRIDE = 16, 8
#: a to z, 7 codes that all other letters share, and the token's end, which tells a word from a longer one that begins alike.
LETTERS, END = 34, 33
#: Single letters apart, as in "i d i o t", also make a token.
APART = re.compile(r"(?<!\S)(?:\S[ \t]){2,}\S(?!\S)")
MARKS = ".,;:!?|\"'()[]#$%&*"


def letters(token: str) -> tuple[list[int], list[int]]:
    """Codes of the letters and of the end, and where they stand."""
    codes, places = [], []
    for i, c in enumerate(token):
        if "a" <= c <= "z":
            codes.append(ord(c) - 97)
            places.append(i)
        elif c.isalpha():
            codes.append(26 + ord(c) % 7)
            places.append(i)
    return [*codes, END], [*places, len(token)]


_triples: dict[int, np.ndarray] = {}


def triples(n: int) -> np.ndarray:
    if n not in _triples:
        _triples[n] = np.array(list(combinations(range(n), 3)), dtype=np.int64).reshape(-1, 3)
    return _triples[n]


def pieces(token: str) -> list[tuple[list[int], list[int]]]:
    codes, places = letters(token.strip(MARKS))
    n = len(codes) - 1
    if n <= PIECE:
        return [(codes, places)]
    ends = [(i, i + PIECE if i + PIECE < n else n + 1) for i in range(0, n - PIECE + STRIDE, STRIDE)]
    return [(codes[i:j], places[i:j]) for i, j in ends]


def weights_of(rows: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Triple codes and their weights for tokens with the same number of letters: two arrays (tokens, triples)."""
    c, p = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1))
    t = triples(c.shape[1])
    code = (c[:, t[:, 0]] * LETTERS + c[:, t[:, 1]]) * LETTERS + c[:, t[:, 2]]
    span = p[:, t[:, 2]] - p[:, t[:, 0]] + 1
    return code, DECAY**span


def self_kernel(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum over distinct triples of (sum of weights) squared, per row."""
    order = np.argsort(code, axis=1)
    code, weight = np.take_along_axis(code, order, 1), np.take_along_axis(weight, order, 1)
    fresh = np.ones(code.shape, dtype=bool)
    fresh[:, 1:] = code[:, 1:] != code[:, :-1]
    sums = np.bincount(np.cumsum(fresh.ravel()) - 1, weights=weight.ravel())
    rows = np.repeat(np.arange(len(code)), fresh.sum(axis=1))
    return np.bincount(rows, weights=sums**2, minlength=len(code))


def vector(token: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and normalised weights of the triples of the token's first piece; none for under three letters."""
    part = pieces(token)[0]
    if len(part[0]) < 4:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    code, weight = weights_of([part])
    return code[0], weight[0] / np.sqrt(self_kernel(code, weight)[0])


def tokens_of(text: str | None) -> set[str]:
    """Words in small letters, and words whose letters stand apart put together."""
    if not text:
        return set()
    low = text.lower()
    return set(low.split()).union(m.replace(" ", "").replace("\t", "") for m in APART.findall(low))


def bag_of(text: str | None) -> list[str]:
    """The tokens with a triple, without marks around them; very long ones in the pieces that decide about them."""
    out = set()
    for token in tokens_of(text):
        bare = token.strip(MARKS)
        if len(bare) <= PIECE:
            out.add(bare)
        else:
            out.update("".join(x) for x in _cut(bare))
    return sorted(t for t in out if sum(map(str.isalpha, t)) >= 3)


def _cut(token: str) -> list[str]:
    """The token's letters in pieces as `pieces` has them, with the marks among them."""
    places = letters(token)[1][:-1]
    if len(places) <= PIECE:
        return [token]
    return [token[places[i] : places[min(i + PIECE, len(places)) - 1] + 1] for i in range(0, len(places) - PIECE + STRIDE, STRIDE)]


@dataclass
class ToxicityModel:
    """table: for each triple its part in the decision. A token decides table . triples / norm + bias."""

    table: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    known: dict[str, float] = field(default_factory=dict)
    room: int = 200_000

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def decide(self, tokens: list[str]) -> None:
        """Adds the decisions for new tokens to `known`."""
        if not tokens:
            return
        by_length: dict[int, list[tuple[int, tuple]]] = {}
        plain: dict[int, list[tuple[int, str]]] = {}
        best = np.full(len(tokens), self.bias)
        for k, token in enumerate(tokens):
            bare = token.strip(MARKS)
            if bare.isascii() and bare.isalpha() and len(bare) <= PIECE:
                if len(bare) >= 3:
                    plain.setdefault(len(bare), []).append((k, bare))
                continue
            for part in pieces(token):
                if len(part[0]) >= 4:
                    by_length.setdefault(len(part[0]), []).append((k, part))
        for n, own in plain.items():
            t = triples(n + 1)
            span = DECAY ** (t[:, 2] - t[:, 0] + 1)
            for i in range(0, len(own), 1024):
                some = own[i : i + 1024]
                c = np.frombuffer("".join(x[1] for x in some).encode(), dtype=np.uint8).reshape(-1, n).astype(np.int64) - 97
                c = np.c_[c, np.full(len(c), END)]
                code = (c[:, t[:, 0]] * LETTERS + c[:, t[:, 1]]) * LETTERS + c[:, t[:, 2]]
                best[[x[0] for x in some]] = self.table[code] @ span / np.sqrt(self_kernel(code, np.broadcast_to(span, code.shape))) + self.bias
        for own in by_length.values():
            for i in range(0, len(own), 1024):
                some = own[i : i + 1024]
                code, weight = weights_of([x[1] for x in some])
                value = (self.table[code] * weight).sum(axis=1) / np.sqrt(self_kernel(code, weight)) + self.bias
                np.maximum.at(best, [x[0] for x in some], value)
        self.known.update(zip(tokens, best.tolist(), strict=True))

    def highest(self, bags: Sequence[set[str]]) -> tuple[np.ndarray, list[str | None]]:
        """Each bag's highest decision and its token; the bias and None for a bag without tokens."""
        known = self.known
        fresh = set().union(*bags).difference(known)
        if len(known) + len(fresh) > self.room:
            known.clear()
            fresh = set().union(*bags)
        self.decide(list(fresh))
        who = [max(own, key=known.__getitem__) if own else None for own in bags]
        return np.array([self.bias if w is None else known[w] for w in who]), who

    def score(self, texts: Sequence[str | None], letters_at_once: int = 1_000_000) -> np.ndarray:
        """The decision of each text's most toxic token. So many texts at a time are cut into tokens that memory stays small."""
        out, bags, first, size = np.full(len(texts), self.bias), [], 0, 0
        for k, t in enumerate(texts):
            bags.append(tokens_of(t))
            size += len(t) if t else 0
            if size > letters_at_once or k == len(texts) - 1:
                out[first : k + 1] = self.highest(bags)[0]
                bags, first, size = [], k + 1, 0
        return out

    def chance(self, decision: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(decision), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -40, 40)))


def fit_tokens(positive: dict[str, float], negative: dict[str, float], landmarks: list[str], cost: float = 30000.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine in the Nyström space of the landmarks, examples weighted, both classes alike: triple table and bias."""
    marks = np.zeros((len(landmarks), LETTERS**3), dtype=np.float32)
    for row, (code, weight) in zip(marks, map(vector, landmarks), strict=True):
        np.add.at(row, code, weight)
    marks = marks[marks.any(axis=1)]
    values, basis = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-5 * values.max()
    by_triple = np.ascontiguousarray(marks.T @ (basis[:, good] / np.sqrt(values[good])).astype(np.float32))  # Nyström features as functions of triples
    del marks
    x = np.array([weight.astype(np.float32) @ by_triple[code] for code, weight in map(vector, [*positive, *negative])], dtype=np.float64)
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    c = np.r_[np.array([*positive.values()]) / sum(positive.values()), np.array([*negative.values()]) / sum(negative.values())] * cost
    w, ridge, inside = np.zeros(x.shape[1]), np.eye(x.shape[1]), np.ones(len(x), dtype=bool)
    ridge[-1, -1] = 1e-6
    for _ in range(steps):  # Newton: a ridge regression on the points inside the margin
        xs = x[inside] * c[inside, None]
        new = np.linalg.solve(ridge + xs.T @ x[inside], xs.T @ y[inside])
        w, before = _descend(w, new, x, y, c), w
        inside = y * (x @ w) < 1
        if np.abs(w - before).max() < 1e-7:
            break
    return (by_triple @ w[:-1].astype(np.float32)).astype(np.float64), float(w[-1])


def _descend(w: np.ndarray, new: np.ndarray, x: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The best of some points from w to new and a little beyond it being halved, by the machine's loss."""

    def loss(v: np.ndarray) -> float:
        return float(v[:-1] @ v[:-1] + 1e-6 * v[-1] ** 2 + (c * np.maximum(0, 1 - y * (x @ v)) ** 2).sum())

    return min((w + t * (new - w) for t in (1.0, 0.5, 0.25, 0.1, 0.03)), key=loss)


def fit_curve(decision: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic slope and shift by Newton steps, with a slight pull to 0 for separable data."""
    x = np.c_[decision, np.ones(len(decision))]
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - label)) + [0.5 * b[0], 0]
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([0.5, 1e-3])
        step = np.linalg.solve(hess, grad)
        b = b - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(b[0]), 1e-3), float(b[1])


class _Bags:
    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                yield pd.DataFrame({"bag": part["bag"], "toxic": part["toxic"], "tokens": [bag_of(t) for t in part["text"]]})


class _Highest:
    def __init__(self, model: ToxicityModel):
        self.model = model

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                decision, who = self.model.highest([set(x) for x in part["tokens"]])
                yield pd.DataFrame({"toxic": part["toxic"], "token": who, "decision": decision})


def _unlikely(bags: DataFrame) -> DataFrame:
    """Each bag's token that is least like a clean one: (toxic, token, decision). A token's bags by class are held against the classes' shares."""
    share = bags.agg(F.avg("toxic")).first()[0]
    one = bags.select("bag", "toxic", F.explode("tokens").alias("token"))
    counts = one.groupBy("token").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    expect = F.col("n") * F.lit(share)
    lift = F.log((F.col("t") + 0.5) / (expect + 0.5)) - F.log((F.col("n") - F.col("t") + 0.5) / (F.col("n") - expect + 0.5))
    rated = one.join(counts.select("token", lift.alias("lift")), "token")
    top = F.max(F.struct("lift", "token")).alias("top")
    return rated.groupBy("bag", "toxic").agg(top).select("toxic", F.col("top.token").alias("token"), F.col("top.lift").alias("decision"))


def inserted(token: str) -> list[str]:
    """The token with one letter put in: between each two of its characters three of the letters, by token and place."""
    return [token[:i] + chr(97 + (crc32(f"{token} {i}".encode()) + 9 * k) % 26) + token[i:] for i in range(1, len(token)) for k in range(3)]


def _times(tokens: pd.Series) -> dict[str, float]:
    return {t: float(n) for t, n in sorted(tokens.dropna().value_counts().items(), key=lambda x: (-x[1], x[0]))}


def train(docs: DataFrame, labels: DataFrame, trainable: Column | None = None, max_per_class: int = 6000, landmarks: int = 384, rounds: int = 4, gapped: float = 1.0) -> ToxicityModel:
    """Fits the model to labels.toxic on `docs` (doc_id, text). trainable: which doc_ids may be learnt from. gapped: what a witness's spellings
    with a letter put in weigh together, the witness itself 1."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if trainable is not None:
        marked = marked.where(trainable)
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return ToxicityModel(np.zeros(LETTERS**3), 0.0, constant=float(1 in counts))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = [marked.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(max_per_class) for k in (0, 1)]
    sample = docs.select("doc_id", "text").join(chosen[0].union(chosen[1]), "doc_id")
    sample = sample.select(F.monotonically_increasing_id().alias("bag"), "text", "toxic")
    bags = Saved(sample.mapInPandas(_Bags(), "bag long, toxic int, tokens array<string>"))

    found = _unlikely(bags.df).toPandas()  # a row a bag
    others = bags.df.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    common = [r["token"] for r in others.orderBy(F.desc("n"), "token").limit(landmarks).collect()]
    some = [r["token"] for r in others.orderBy(F.xxhash64("token"), "token").limit(landmarks).collect()]
    negative, model = {}, None
    for _ in range(rounds):
        positive = _times(found.loc[found["toxic"] == 1, "token"])
        for t, n in _times(found.loc[found["toxic"] == 0, "token"]).items():
            negative[t] = max(n, negative.get(t, 0.0))
        if not positive or not negative:
            break
        firm = {t: n for t, n in positive.items() if t not in negative or n > negative[t]} or positive
        parts = ((firm, landmarks // 2), (negative, landmarks // 4), (common, landmarks // 8), (some, landmarks // 8))
        marks = list(dict.fromkeys(t for tokens, n in parts for t in list(tokens)[:n]))
        examples = {t: 1.0 for t in (*common, *some) if t not in positive} | negative
        spelt = {v: n * gapped / len(own) for t, n in firm.items() for own in [inserted(t)] for v in own if v not in examples}
        model = ToxicityModel(*fit_tokens(spelt | positive, examples, marks))
        before = set(positive)
        found = bags.df.mapInPandas(_Highest(model), "toxic int, token string, decision double").toPandas()  # a row a bag
        if set(found.loc[found["toxic"] == 1, "token"].dropna()) == before:
            break
    bags.drop()
    if model is None:
        return ToxicityModel(np.zeros(LETTERS**3), 0.0, constant=counts[1] / (counts[0] + counts[1]))
    y = found["toxic"].to_numpy(float)
    weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    weight *= len(y) / max(1.0, weight.sum())
    model.slope, model.shift = fit_curve(found["decision"].to_numpy(), y, weight)
    model.known.clear()
    return model


class _Scorer:
    def __init__(self, model: ToxicityModel, extra: list[str]):
        self.model, self.extra = model, extra

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = self.model.score(b["text"])
            yield pd.DataFrame({c: b[c] for c in self.extra} | {"decision": d, "score": self.model.chance(d)})


def score(docs: DataFrame, model: ToxicityModel, extra: list[str] | None = None) -> DataFrame:
    """doc_id and the `extra` columns, decision and score (0 to 1) of each document's whole text."""
    keep = list(dict.fromkeys(["doc_id", *(extra or [])]))
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "decision double, score double"])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInPandas(_Scorer(model, keep), schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def detect(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, extra: list[str] | None = None, **options) -> DataFrame:
    """Trains outside the held-out part of the labels, then scores all documents: held_out, score, predicted."""
    model = train(docs, labels, ~held_out(F.col("doc_id")), **options)
    scored = score(docs, model, extra)
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores under the threshold. Only texts go to Python."""

    @F.pandas_udf("double")
    def chance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(model.chance(model.score(b)))

    return docs.where(chance(F.col("text")) < threshold)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return detect(docs, labels).select("doc_id", "held_out", "score", "predicted")

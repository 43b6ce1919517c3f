"""Word-piece counts by a linear longest-match automaton.

The vocabulary stands in one trie with two roots: pieces that begin a word and pieces that continue one. Each node has a
failure link and the number of pieces that following it pops, both worked out beforehand; a word then takes one step or one link a
character, and its number of pieces is the sum of the numbers, without any piece being built. A word that can't be
cut into pieces counts as one unknown piece.

The vocabulary comes from a SentencePiece model: pieces with the word mark begin words, the others continue them.

Edge cases: null and empty texts have no words; words of any length are counted whole; repeated rows each get their
row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame

from formlake.llm.sentencepiece_codec import MARK, MODEL, vocabulary


class Automaton:
    """begin, go_on: the pieces that begin and that continue words. Node 0: the former's root, 1: the latter's."""

    def __init__(self, begin: set[str], go_on: set[str], room: int = 600_000):
        self.step: list[dict[str, int]] = [{}, {}]
        final = {}
        for root, pieces in ((0, begin), (1, go_on)):
            for piece in sorted(pieces):
                at = root
                for c in piece:
                    at = self.step[at].setdefault(c, len(self.step))
                    if at == len(self.step):
                        self.step.append({})
                if piece:
                    final[at] = True
        n = len(self.step)
        self.link: list[int] = [-1] * n  # -1: no way on
        self.pops: list[int] = [0] * n
        todo = deque([0, 1])
        while todo:  # parents before children, and both tries level by level
            u = todo.popleft()
            for c, v in self.step[u].items():
                if v in final:
                    self.link[v], self.pops[v] = 1, 1
                else:
                    z, popped = self.link[u], self.pops[u]
                    while z >= 0 and c not in self.step[z]:
                        popped += self.pops[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.pops[v] = self.step[z][c], popped
                todo.append(v)
        self.room, self.known = room, {}

    def count(self, word: str) -> int:
        """Pieces of the word by greedy longest match; -1 if some part fits none."""
        step, link, pops = self.step, self.link, self.pops
        at, n = 0, 0
        for c in word:
            nxt = step[at].get(c)
            while nxt is None:
                n += pops[at]
                at = link[at]
                if at < 0:
                    return -1
                nxt = step[at].get(c)
            at = nxt
        while at > 1:
            n += pops[at]
            at = link[at]
        return -1 if at < 0 else n

    def counts(self, words: list[str]) -> tuple[int, int]:
        """Pieces and unknown words."""
        known = self.known
        for w in set(words).difference(known):
            known[w] = self.count(w)
        found = list(map(known.__getitem__, words))
        unknown = found.count(-1)
        if len(known) > self.room:
            known.clear()
        return sum(found) + 2 * unknown, unknown


@cache
def automaton(model: str) -> Automaton:
    pieces = vocabulary(model).ids
    return Automaton({p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]}, {p for p in pieces if MARK not in p})


class _Counter:
    def __init__(self, model: str):
        self.model = model

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = automaton(self.model)
        for b in batches:
            rows = []
            for t in b["text"].tolist():
                words = t.split() if t else []
                rows.append((len(words), *own.counts(words)))
            out = pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"], dtype="int64")
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out


def count_tokens(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_words, n_tokens (unknown words count one), n_unknown."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(_Counter(model), f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""String similarity as Arrow-batched functions: gestalt ratio, and ratios of the longest common subsequence."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from formlake.functions import fixed


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & place.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def _letters(texts: list[str], width: int, fill: int) -> np.ndarray:
    """Code points, one text a row, filled up with a value that no letter has."""
    out = np.full((len(texts), width), fill, dtype=np.uint32)
    out[np.arange(width) < np.array(list(map(len, texts)))[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return out


def common_many(a: list[str], b: list[str], chunk: int = 4096) -> np.ndarray:
    """common of many pairs: their bit vectors advance side by side, a letter of the longer text at a time. Pairs of texts over 64 letters go one by one."""
    short, long = zip(*((x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)), strict=True) if a else ((), ())
    n, m = np.array(list(map(len, short)), dtype=np.int64), np.array(list(map(len, long)), dtype=np.int64)
    out = np.zeros(len(n), dtype=np.int64)
    for i in np.flatnonzero(n > 64).tolist():
        out[i] = common(short[i], long[i])
    order = np.argsort(m, kind="stable")
    order = order[(n[order] > 0) & (n[order] <= 64)]
    for lo in range(0, len(order), chunk):
        own = order[lo : lo + chunk]
        x = _letters([short[i] for i in own], 64, 0xFFFFFFFF)
        y = _letters([long[i] for i in own], int(m[own].max()), 0xFFFFFFFE)
        s = np.full(len(own), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for k in range(y.shape[1]):
            u = s & np.packbits(x == y[:, k : k + 1], axis=1, bitorder="little").view("<u8").ravel()
            s = (s + u) | (s - u)
        unused = np.uint64(64) - n[own].astype(np.uint64)
        out[own] = n[own] - np.bitwise_count(s << unused).astype(np.int64)
    return out


def ratio(a: str, b: str) -> float:
    """0 to 100: twice the common subsequence over both lengths; 100 for two empty texts."""
    return 200 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """ratio of many pairs; equal pairs are worked out once."""
    where = {p: i for i, p in enumerate(dict.fromkeys(pairs))}
    a, b = [x for x, _ in where], [y for _, y in where]
    size = np.array([len(x) + len(y) for x, y in where], dtype=np.int64)
    found = np.where(size > 0, 200 * common_many(a, b) / np.maximum(size, 1), 100.0)
    return found[np.array([where[p] for p in pairs], dtype=np.int64)]


#: What a score is made of: a fixed value, or pairs of texts of which the highest ratio counts.
Parts = float | list[tuple[str, str]]


def _value(parts: Parts) -> float:
    return parts if isinstance(parts, float) else max(ratio(x, y) for x, y in parts)


def token_sort_parts(a: str, b: str) -> Parts:
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 100.0 if x == y else [(x, y)]


def token_set_parts(a: str, b: str) -> Parts:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 100.0
    base = " ".join(both)
    with_x, with_y = (" ".join(filter(None, [base, " ".join(o)])) for o in (only_x, only_y))
    return [(with_x, with_y), *([(base, with_x), (base, with_y)] if base else [])]


def partial_parts(a: str, b: str) -> Parts:
    """The shorter text with each window of its length of the longer one, windows over the ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    return [(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)) if b[max(0, i) : i + n]]


def token_sort_ratio(a: str, b: str) -> float:
    return _value(token_sort_parts(a, b))


def token_set_ratio(a: str, b: str) -> float:
    return _value(token_set_parts(a, b))


def partial_ratio(a: str, b: str) -> float:
    return _value(partial_parts(a, b))


def gestalt(a: str, b: str) -> float:
    return SequenceMatcher(None, a.strip().lower(), b.strip().lower()).ratio()


def default_parts(a: str, b: str) -> Parts:
    return token_sort_parts(a.strip(), b.strip())


def name_parts(a: str, b: str) -> Parts:
    if not a or not b:
        return 0.0
    a, b = a.strip().lower(), b.strip().lower()
    if a == b:
        return 100.0
    whole = token_sort_parts(a, b)
    if isinstance(whole, float):
        return whole  # none is higher
    part = partial_parts(a, b)
    return whole + (part if isinstance(part, list) else [])  # no parts: one of them is empty, and so is every ratio


def address_parts(a: str, b: str) -> Parts:
    return token_set_parts(a.strip(), b.strip()) if a and b else 0.0


def number_parts(a: str, b: str) -> Parts:
    if not a or not b:
        return 0.0
    drop = str.maketrans("", "", " -()")
    a, b = ("".join(x.split()).translate(drop) for x in (a, b))
    return 100.0 if a == b else [(a, b)]


PARTS = {"name": name_parts, "address": address_parts, "number": number_parts, "default": default_parts, "gestalt": lambda a, b: 100 * gestalt(a, b), "ratio": lambda a, b: [(a, b)]}


def default_score(a: str, b: str) -> float:
    return _value(default_parts(a, b)) / 100


def name_score(a: str, b: str) -> float:
    return _value(name_parts(a, b)) / 100


def address_score(a: str, b: str) -> float:
    return _value(address_parts(a, b)) / 100


def number_score(a: str, b: str) -> float:
    return _value(number_parts(a, b)) / 100


def scores(kind: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratios of a whole batch together, each distinct row once."""
    rows = list(zip(kind, a, b, strict=True))
    known: dict[tuple, float | None] = {}
    pairs, begin, owners = [], [], []
    for row in dict.fromkeys(rows):
        if row[1] is None or row[2] is None:
            known[row] = None
            continue
        parts = PARTS[row[0]](row[1], row[2])
        if isinstance(parts, float):
            known[row] = parts / 100
        else:
            owners.append(row)
            begin.append(len(pairs))
            pairs += parts
    if pairs:
        known |= zip(owners, (np.maximum.reduceat(ratios(pairs), begin) / 100).tolist(), strict=True)
    return pd.Series([known[r] for r in rows], dtype="float64")


def similarity(kind: Column, a: Column | str, b: Column | str) -> Column:
    """Similarity (0 to 1) of a and b by the strategy that `kind` names; null if either is null."""
    return F.pandas_udf(scores, "double")(kind, a, b)


def strategy(field: Column) -> Column:
    """How values of a field are compared, by parts of its name."""
    name = F.lower(field)
    out = None
    for label, parts in (("name", fixed.NAME_WORDS), ("address", fixed.ADDRESS_WORDS), ("number", fixed.NUMBER_WORDS)):
        hit = name.rlike("|".join(parts))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("default")

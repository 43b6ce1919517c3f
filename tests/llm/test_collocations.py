"""Collocations against plain counting: pieces, languages, cuts, ties, containment, and shards of every size."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from formlake.llm import collocations as C

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=2000, least=10, inside=50, longest=3):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(100 * b >= inside * a for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, _, low, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), low, right))
        for rank, (score, a, p, low, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, low, right, total[lang], -score))
    return sorted(out)


def some_rows(seed, n=300):
    r = random.Random(seed)
    words = ["new", "York", "NEW", "york", "city", "of", "the", "a", "in", "Ünder", "élan", "x y", "\x1cq", "日本", "long-word", "o'clock"]
    rows = []
    for _ in range(n):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "!?", " ; "]) for _ in range(r.randrange(0, 40)))
        rows.append((r.choice(["en", "de", None, "und", ""]), text))
    return [*rows, ("en", None), (None, ""), ("en", ". , ;"), ("en", "new york city " * 200), *[rows[0]] * 15]


@pytest.mark.parametrize("options", [{}, {"room": 50}, {"top": 7, "salts": 3}, {"longest": 4, "least": 5, "inside": 80, "room": 700}, {"longest": 2}])
def test_against_counting(spark, options):
    rows = some_rows(len(options))
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "lang string, text string, phrase long").repartition(4)
    got = sorted(tuple(x) for x in C.collocations(df, **options).collect())
    assert got and got == brute(rows, **{k: v for k, v in options.items() if k not in ("room", "salts")})


def test_products_over_64_bits(spark):
    big = 10**13
    df = spark.createDataFrame([("en", 1, "p", 3 * big), ("en", 1, "q", 2 * big), ("en", 2, "p q", big)], "lang string, size int, phrase string, a long")
    C_phrase_counts, C.phrase_counts = C.phrase_counts, lambda *a: df
    try:
        assert [tuple(x) for x in C.collocations(None).collect()] == [("en", 1, "p q", big, 3 * big, 2 * big, 5 * big, 1_000_000 // 6)]
    finally:
        C.phrase_counts = C_phrase_counts


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_suffix_array_orders_by_the_first_words():
    r = np.random.default_rng(1)
    for longest in (1, 2, 3, 5):
        ids = r.integers(0, 4, 300) + (1 << 40) * (longest == 3)
        order = C.suffix_array(ids, longest)
        heads = [tuple(ids[i : i + longest]) for i in order.tolist()]
        assert sorted(order.tolist()) == list(range(300)) and heads == sorted(heads)

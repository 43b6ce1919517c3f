"""Inserted letters, columns that no score may see, and a document's decision against the kernel by definition."""

import random
from itertools import combinations

import numpy as np
import pytest

from formlake.llm import toxicity


@pytest.fixture(scope="module")
def marked(spark):
    r = random.Random(21)
    word = lambda n: "".join(r.choice("abcdefghilmnoprstu") for _ in range(n))
    plain = [word(r.randrange(3, 10)) for _ in range(300)]
    rows = []
    for i in range(800):
        words = r.choices(plain, k=20)
        if i % 4 == 0:
            words.insert(r.randrange(20), ("blockhead", "nitwit", "dunderpate")[i // 4 % 3])
        rows.append((i, " ".join(words), ("en", "de")[i % 2], int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def test_insults_with_a_letter_put_in(spark, marked):
    model = toxicity.train(marked, marked)
    spelt = [w[:i] + x + w[i:] for w in ("blockhead", "nitwit", "dunderpate") for i in range(1, len(w)) for x in "xqjz"]
    caught = model.chance(model.score(spelt)) >= 0.3
    assert caught.mean() >= 0.8 and caught[spelt.index("nitxwit")]
    clean = [r["text"] for r in marked.where("toxic = 0").collect()]
    assert (model.chance(model.score(clean)) >= 0.3).mean() < 0.02


def test_inserted_by_definition():
    got = toxicity.inserted("abc")
    assert len(got) == 6 and all(len(t) == 4 and t[0] == "a" and t[-1] == "c" for t in got)
    assert toxicity.inserted("a") == [] and toxicity.inserted("") == []


def test_language_is_never_learnt_from(spark, marked):
    with_lang, without = toxicity.train(marked, marked), toxicity.train(marked.drop("lang"), marked.drop("lang"))
    assert np.array_equal(with_lang.table, without.table) and with_lang.bias == without.bias


def test_decision_of_a_document_by_brute_force(spark):
    positive, negative = {"nitwit": 2.0, "dunderpate": 1.0}, {"nitrate": 1.0, "under": 2.0, "plate": 1.0}
    table, bias = toxicity.fit_tokens(positive, negative, [*positive, *negative])
    model = toxicity.ToxicityModel(table, bias)

    def slow(token: str) -> float:
        codes, places = toxicity.letters(token)
        weights: dict[int, float] = {}
        for i, j, k in combinations(range(len(codes)), 3):
            at = (codes[i] * toxicity.LETTERS + codes[j]) * toxicity.LETTERS + codes[k]
            weights[at] = weights.get(at, 0.0) + toxicity.DECAY ** (places[k] - places[i] + 1)
        norm = sum(w * w for w in weights.values()) ** 0.5
        return sum(w * table[at] for at, w in weights.items()) / norm + bias

    text = "the under-plate of a n1twit met nitrate and d u n d e r pates"
    want = max(slow(t) for t in toxicity.tokens_of(text) if sum(map(str.isalpha, t)) >= 3)
    assert model.score([text])[0] == pytest.approx(want, rel=1e-6)

"""Batched ratios against the plain formulas, and resolved keys against every pair of a document."""

import random
from difflib import SequenceMatcher

import pandas as pd

from formlake.functions import similarity as S
from formlake.operators import verify


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcé 🙂_-1") for _ in range(r.choice([0, 1, 3, 9, 20, 63, 64, 65, 130]))) for _ in range(n)]


def test_many_pairs_against_the_table():
    a, b = texts(1, 300), texts(2, 300)
    a[0], b[0] = "x" * 64, "x" * 64
    assert S.common_many(a, b, chunk=50).tolist() == [plain_common(x, y) for x, y in zip(a, b, strict=True)] == [S.common(x, y) for x, y in zip(a, b, strict=True)]
    assert S.common_many([], []).tolist() == []


def test_batches_against_single_scores():
    r = random.Random(3)
    words = ["John", "smith", "Ann", "12", "High", "road", "", "  ", "ünal", "x" * 70]
    phrase = lambda: " ".join(r.choice(words) for _ in range(r.randrange(0, 5)))
    rows = [(r.choice([*S.PARTS]), phrase(), phrase()) for _ in range(400)] + [("name", None, "x"), ("ratio", "", ""), ("default", "a b", "b a")]
    rows += rows[:50]
    single = {"name": S.name_score, "address": S.address_score, "number": S.number_score, "default": S.default_score, "gestalt": S.gestalt, "ratio": lambda a, b: S.ratio(a, b) / 100}
    got = S.scores(*(pd.Series(c) for c in zip(*rows, strict=True)))
    for row, x in zip(rows, got, strict=True):
        want = None if None in row else single[row[0]](row[1], row[2])
        assert (pd.isna(x) and want is None) or abs(x - want) < 1e-12, row
    assert S.gestalt(" AB ", "ab") == 1.0 and S.gestalt("abcd", "bcde") == SequenceMatcher(None, "abcd", "bcde").ratio()


def test_keys_against_all_pairs(spark):
    r = random.Random(9)
    keys = ["name", "full_name", "my_name", "dob", "date_of_birth", "birth_date", "email", "e_mail", "phone", "phone_no", "PAN", "pan_number", "x", "", "aaa", "aa", "zip", "zip_code", "🙂key", "keys"]
    sub = [(d, k, f"v{i}") for d in range(60) for i, k in enumerate(r.sample(keys, 6))]
    have = [(d, k + r.choice(["", "", "s", "_"]), f"w{i}") for d in range(60) for i, k in enumerate(r.sample(keys, 7))]
    have = list({(d, k): (d, k, v) for d, k, v in have}.values())
    a, b = spark.createDataFrame(sub, "doc_id long, field string, submitted string"), spark.createDataFrame(have, "doc_id long, field string, value string")
    got = {(x["doc_id"], x["field"]): (x["tier"], x["key"], x["extracted"]) for x in verify.resolve_keys(a, b).collect()}
    want = {}
    for d, f, _ in sub:
        own = {k: v for e, k, v in have if e == d}
        low = max((k for k in own if k.lower() == f.lower()), default=None)
        near = max(((S.ratio(f, k) / 100, k) for k in own), default=(0, ""))
        tier, key = (1, f) if f in own else (2, low) if low is not None else (3, near[1]) if near[0] >= 0.7 else (None, None)
        want[d, f] = (tier, key, own.get(key))
    assert got == want and sum(t == 3 for t, _, _ in want.values()) > 10


def test_pairs_of_keys_are_scored_once(spark):
    sub = spark.createDataFrame([(d, "my_name", "v") for d in range(200)], "doc_id long, field string, submitted string")
    have = spark.createDataFrame([(d, k, "w") for d in range(200) for k in ("name", "zz", "my_nam")], "doc_id long, key string, extracted string")
    found = verify.alike_keys(sub.select("doc_id", "field"), have.select("doc_id", "key"))
    assert found.count() == 400 and found.select("field", "key", "score").distinct().count() == 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("ArrowEvalPython")]
    assert "Join" in above and "Aggregate" in plan[plan.index("ArrowEvalPython") :]


def test_prefixes_are_worked_out_once_a_text(spark):
    rows = spark.createDataFrame([(d, f"my_key{d % 3}", f"key{d % 3}") for d in range(60)], "doc_id long, field string, key string")
    found = verify.alike_keys(rows.select("doc_id", "field"), rows.select("doc_id", "key"))
    assert {(x["doc_id"], x["field"], x["key"]) for x in found.collect()} == {(d, f"my_key{d % 3}", f"key{d % 3}") for d in range(60)}
    # Spark puts no filter on prefixes (of which array_position is a part) below the distinct texts
    assert not [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x and "array_position" in x]


def test_texts_of_equal_words_have_no_parts():
    assert S.default_parts("b a", "a  b ") == 100.0 and S.name_parts("Ann Lee", "lee ann") == 100.0 and S.default_parts("", " ") == 100.0
    assert S.default_score("b a", "a c") == S.ratio("a b", "a c") / 100

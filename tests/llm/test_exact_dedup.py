"""Exact deduplication against brute force: copies across tasks, clashing digests, hot groups, and rows of all odd kinds."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from formlake.llm import exact_dedup


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    out = []
    for doc_id, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        keep = min((i for i in groups[body] if i is not None), default=None)
        out.append((doc_id, keep, len(groups[body]), doc_id == keep, body))
    return out


def some_rows(seed=1, n=400):
    r = random.Random(seed)
    texts = ["", None, " ", "\t", "a b", "a  b", "a\nb", " a b", "a b ", "a b", "A b", "x" * 200_000, "x" * 199_999 + "y", *[f"text {i}" for i in range(60)]]
    rows = [(i, "the hot text\nof many rows" if r.random() < 0.35 else r.choice(texts)) for i in range(n)]
    r.shuffle(rows)
    return rows


def digest_of_two(text):
    """Two digests in all, so that every group clashes."""
    return F.substring(F.sha2(text, 256), 1, 1).isin(*"01234567").cast("string")


@pytest.mark.parametrize("digest", [exact_dedup.sha256, digest_of_two])
@pytest.mark.parametrize("salts", [None, 3])
def test_classes(spark, digest, salts):
    rows = [*some_rows(), (None, "alone without a number"), (None, "text 3"), (7, "text 3"), (7, "text 3")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = exact_dedup.classes(df, salts, digest).collect()
    want = brute(rows)
    assert sorted(map(str, ((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got))) == sorted(str(w[:4]) for w in want)
    if digest is exact_dedup.sha256:
        assert sorted(r["digest"] for r in got) == sorted(hashlib.sha256(w[4].encode()).hexdigest() for w in want)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, digest_of_two])
def test_dedup_keeps_one_row_of_each_text_and_all_columns(spark, digest):
    names = ["digest", "body", "keep", "n", "group", "hot", "own", "key", "a.b", "row"]
    rows = [*some_rows(2), (None, "no number"), (None, "no number"), (5000, "twice"), (5000, "twice"), (5001, "twice")]
    df = spark.createDataFrame([(*x, *names) for x in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = exact_dedup.dedup(df.repartition(5), digest=digest)
    assert got.columns == df.columns
    out = got.collect()
    assert all(tuple(x)[2:] == tuple(names) for x in out)
    kept = {(i, b) for i, _, _, kept, b in brute(rows) if kept}
    assert sorted((x["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", x["text"] or "")) for x in out if x["doc_id"] is not None) == sorted(k for k in kept if k[0] is not None)
    assert sum(x["doc_id"] is None for x in out) == 1 and len(out) == len(kept)


def test_empty_table_and_text_ids(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert exact_dedup.classes(none).collect() == [] and exact_dedup.dedup(none).collect() == []
    some = spark.createDataFrame([("b", "t"), ("a", "t")], "doc_id string, text string")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.classes(some).collect()} == {("a", "a", True), ("b", "a", False)}


def test_no_python_and_texts_meet_only_in_salted_and_final_groups(spark):
    df = spark.createDataFrame(some_rows(3, 50), "doc_id long, text string")
    bodies = exact_dedup._bodies(df, exact_dedup.sha256)
    plan = exact_dedup._merged(bodies, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") == 2 and plan.count("partial_") >= 4

"""Worked cases of field mapping, and agreement of patterns with Python's re."""

import re

import pytest
from pyspark.sql import functions as F

from formlake.functions import fixed
from formlake.functions.text import first_group
from formlake.operators import extract, templates

CASES = {
    1: ("Full Name: Asha Rao\nDate of Birth: 03/04/1990\nPhone: 9876543210\nEmail: asha@example.com\nPAN: ABCDE1234F\nBlood Group: AB+",
        {"name": ("Asha Rao", 1.0), "full_name": ("Asha Rao", 0.5), "date_of_birth": ("03/04/1990", 0.5), "phone": ("987654321", 1.0), "email": ("asha@example.com", 1.0),
         "pan_number": ("ABCDE1234F", 1.0), "pan": ("ABCDE1234F", 0.5), "blood_group": ("AB+", 0.5)}),
    2: ("Name:\nRavi Kumar\nMobile: 98765 43210", {"name": ("Ravi Kumar", 1.0), "phone": ("98765 43210", 1.0), "mobile": ("98765 43210", 0.6)}),
    3: ("Father's Name: Ravi\nName: Asha", {"father_name": ("Ravi", 0.9), "fathers_name": ("Ravi", 0.5), "name": ("Ravi", 0.9)}),
    4: ("plain prose only here\n12 34", {"name": ("plain prose only here", 1.0)}),
    5: ("  ", {}),
}


@pytest.fixture(scope="module")
def mapped(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "doc_id long, text string")
    aliases = templates.aliases(templates.defaults(spark))
    out = {}
    for r in extract.map_fields(docs, aliases).collect():
        out.setdefault(r["doc_id"], {})[r["field"]] = (r["value"], round(r["confidence"], 6))
    return out


@pytest.mark.parametrize("case", CASES)
def test_worked_cases(mapped, case):
    assert mapped.get(case, {}) == CASES[case][1]


def test_patterns_agree_with_python(spark):
    texts = [t for t, _ in CASES.values()] + ["x\ry: Name: A B C", "address: 12 Road\nphone 9000000001", "UID 1234 5678 9012 9", "e-mail a.b@c.org\nCity: Köln, Town", "Asha Rao\nRavi, x", "x1\nRavi\n\nasha rao \nA b", "Asha Rao\nRavi A", "A\nRao Asha", "über Rao\nab cd ", "one " * 9000 + "end", "word " * 3000 + "."]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    patterns = [p for ps, _ in fixed.MAPPER_FIELDS.values() for p in ps]
    got = docs.select("doc_id", *[first_group(F.col("text"), p).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    for r in got:
        for i, p in enumerate(patterns):
            m = re.search(p, texts[r["doc_id"]], re.IGNORECASE | re.MULTILINE)
            assert r[f"p{i}"] == (m.group(1) if m else ""), p


def test_partitioning_does_not_matter(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "doc_id long, text string")
    one, many = (sorted(map(tuple, extract.map_fields(docs.repartition(n)).collect())) for n in (1, 8))
    assert one == many


def test_pages_join_in_order(spark):
    pages = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, " "), (2, 0, None)], "doc_id int, page_idx int, text string")
    assert [tuple(r) for r in extract.join_pages(pages).collect()] == [(1, "a\n\nc")]


def test_templates_grow_and_reload(spark, tmp_path):
    base = templates.defaults(spark)
    more = templates.add(base, "mapper", "badge", [r"badge\s*:?\s*(\w+)"], synonyms=["badge_no"])
    more = templates.learn(more, "badge2", "badge2: ")
    templates.save(more, f"{tmp_path}/t")
    back = templates.load(base, f"{tmp_path}/t")
    assert back.count() == base.count() + 2
    with pytest.raises(ValueError):
        templates.add(base, "mapper", "bad", ["no group"])


def test_needed_words_lose_nothing(spark, monkeypatch):
    texts = [t for t, _ in CASES.values()] + ["\u017fex: male", "UID 1234 5678 9012", "Home Address: 1 Road", "dl no 77-AB", "born on 1/2/1990", "EPIC ABC1234567", "telephone 9876543210"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    quick = sorted(map(tuple, extract.extract_fields(docs).collect()))
    monkeypatch.setattr(extract, "_WORDS", {})
    assert quick == sorted(map(tuple, extract.extract_fields(docs).collect()))

"""Templates as data, imports by level, and the hand-writing pass that always runs, each against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from formlake.functions import fixed
from formlake.operators import extract, graph, route, templates


def test_learnt_added_and_loaded_templates_take_effect(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Badge no: K-77\nshelf = 12"), (2, "nothing"), (3, None), (4, "")], "doc_id long, text string")
    base = templates.defaults(spark)
    assert templates.match(docs, base).where("field in ('badge', 'shelf')").count() == 0
    one = templates.learn(base, "badge", r"badge\s+no\s*[:]\s*")
    two = templates.add(one, "matcher", "shelf", [r"shelf\s*[=]\s*"], [r"(\d+)"])
    found = {(r["doc_id"], r["field"], r["value"]) for r in templates.match(docs, two).collect()}
    assert found == {(1, "badge", "K-77"), (1, "shelf", "12")}
    templates.save(two, str(tmp_path / "t"))
    again = {(r["doc_id"], r["field"], r["value"]) for r in templates.match(docs, templates.load(base, str(tmp_path / "t"))).collect()}
    assert again == found


def test_versions(spark):
    rows = [("matcher", "x", [p], [], [], False, t, v) for p, t, v in [("first:", 0.7, 1), ("second:", 0.7, 2), ("third:", 0.95, 3)]]
    history = spark.createDataFrame(rows, templates.SCHEMA)
    docs = spark.createDataFrame([(1, "first: one\nsecond: two\nthird: six")], "doc_id long, text string")
    values = [[r["value"] for r in templates.match(docs, templates.latest(history, v)).collect()] for v in (0, 1, 2, 3)]
    assert values == [[], ["one"], ["two"], []]  # the third one's threshold is above 0.7
    assert [r["version"] for r in templates.latest(history, 2).collect()] == [2] and [r["version"] for r in templates.latest(history).collect()] == [3]
    assert templates.match(docs, history.limit(0)).count() == 0
    with pytest.raises(ValueError):
        templates.fields(history.withColumn("name", F.col("version").cast("string")), most=2)


def test_synonym_hits(spark):
    docs = spark.createDataFrame([(1, "DOB and E-mail"), (2, None), (3, "dob dob")], "doc_id long, text string")
    got = {(r["registry"], r["name"]): r["n_docs"] for r in templates.synonym_hits(docs, templates.defaults(spark)).collect()}
    texts = ["dob and e-mail", "dob dob"]
    want = {("mapper", k): sum(any(s.lower() in t for s in own) for t in texts) for k, (_, own) in fixed.MAPPER_FIELDS.items()}
    want |= {("matcher", k): sum(any(s.lower() in t for s in own) for t in texts) for k, (_, _, own) in fixed.MATCHER_FIELDS.items()}
    assert got == want


SOURCE = "import os, pk.a.b as c, pk\nfrom . import x\n  from .y import (z)\nfrom ..q.r import s\nfrom ... import t\nfrom pk.w import v\nfrom .imports import u\nfrom.near import k\n# import pk.no\nimportlib.x\n"


def surveyed(path, proper):
    """The edges of SOURCE in a file below pk/, by plain Python."""
    parts = path.split("pk/", 1)[1].removesuffix(".py").split("/")
    src = ["pk", *parts]
    out = {"pk.a.b", "pk", "pk.w"}
    for level, module in ((1, ""), (1, "y"), (2, "q.r"), (3, ""), (1, "imports"), (1, "near")):
        stay = len(src) - level if proper else len(src) - level + 1
        if stay >= (1 if proper else 2):
            out.add(".".join([*src[:stay], *([module] if module else [])]))
    name = ".".join(src)
    return {(name.removesuffix(".__init__") if proper else name, d) for d in out}


@pytest.mark.parametrize("proper", [False, True])
def test_imports_by_level(spark, proper):
    paths = ["/r/pk/m.py", "/r/pk/d/m.py", "/r/pk/d/e/m.py", "/r/pk/d/__init__.py", "pk/__init__.py"]
    rows = [(p, SOURCE) for p in paths] + [("/r/other/m.py", SOURCE), ("/r/xpk/m.py", SOURCE), ("/r/pk/n.py", None), ("/r/pk/o.txt", SOURCE), (None, SOURCE)]
    got = {tuple(r) for r in graph.scan_imports(spark.createDataFrame(rows, "path string, value string"), "pk", proper).collect()}
    assert got == set().union(*(surveyed(p, proper) for p in paths))


def test_retry_modes(spark):
    rows = spark.createDataFrame([("x" * 50, "printed"), ("x", "printed"), (None, "tesseract"), ("x", "handwritten")], "t string, e string")
    got = {m: [r[0] for r in rows.select(route.needs_retry(F.col("t"), F.col("e"), m)).collect()] for m in ("off", "auto", "always")}
    assert got == {"off": [False] * 4, "auto": [False, True, True, False], "always": [True, True, True, False]}


def test_available_fields_by_brute_force(spark):
    texts = ["Name: A B\nPhone: 98-76 543210\nAddress: 4 Long Road, Town", "PAN ABCDE1234F", "the sexton's postal code: 123456", "", None, "Mobile no 12345 67890\nblood group: O+"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set()
    for i, t in enumerate(texts):
        low = (t or "").lower()
        want |= {(i, k) for k, (patterns, synonyms) in fixed.MAPPER_FIELDS.items() if any(re.search(p, low, re.I | re.M) for p in patterns) or any(s.lower() in low for s in synonyms)}
    assert {tuple(r) for r in extract.available_fields(docs).collect()} == want

"""The line matcher and the merger against plain Python on random forms: every label, mark and line end, long and odd ones too."""

import random
import re

import pytest

from formlake.functions import fixed
from formlake.operators import extract, templates

LABELS = ["Name", "Full Name", "full  name", "DOB", "Date of Birth", "D.O.B", "Email", "E-mail", "Phone", "Mobile", "Address", "PAN", "Aadhaar", "Passport No", "License", "ID No", "document number", "name is John",
          "Father's Name", "city", "city name", "x", "my_key", "Some Label", "Name =", "phone=", "_id_", "City", "applicant name", "blood group", "gender"]
VALUES = ["John Smith", "12/03/1999", "a.b@c.org", "9876543210", "+1 555 123 4567", "12 High Road, Town", "ABCDE1234F", "1234 5678 9012", "Z1234567", "AB12345678", "", ":", "  ", "x", "male", "é ü"]


def forms(seed, n=250):
    r = random.Random(seed)
    line = lambda: r.choice(LABELS) + r.choice([":", " : ", ": ", "", "=", " "]) + r.choice(VALUES) + r.choice(["\n", "\n", "\r\n", " ", "\n\n", "\r", "\x85"])
    texts = ["".join(line() for _ in range(r.randrange(12))) for _ in range(n)]
    return [None, "", "\n", ":", *texts, "".join(line() for _ in range(3000)), texts[-1], texts[-1]]


def confidence(value, pattern):
    c = 0.5 + (0.3 if pattern and re.match(pattern, value) else 0) + (0.1 if len(value) > 2 else 0)
    return min(1.0, c + (0 if re.fullmatch(r"[^\w\s]+", value) else 0.1))


def matches(text):
    lines = text.splitlines()
    out = {}
    for field, (labels, patterns, _) in fixed.MATCHER_FIELDS.items():
        found = []
        for at, line in enumerate(lines):
            for i, label in enumerate(labels):
                hit = re.search(label, line, re.I)
                if not hit:
                    continue
                rest = line[hit.end():].strip()
                values = [(k, 0, m.group(1).strip()) for k, p in enumerate(patterns) if (m := re.search(p, rest))]
                if not rest and at + 1 < len(lines):
                    values.append((99, 1, lines[at + 1].strip()))
                found += [(-confidence(v, patterns[k] if k < 99 else None), i, at, k, below, v) for k, below, v in values if v]
        if found and -min(found)[0] >= fixed.MATCHER_THRESHOLD:
            c, i, at, _, below, v = min(found)
            out[field] = (v, round(-c, 6), i, at + below)
    return out


def key(label, strip_marks):
    k = re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "", label).lower())
    return k.strip("_") if strip_marks else k


def pairs(lines, strip_marks):
    for line in lines:
        label, colon, value = line.partition(":")
        if colon and value.strip():
            yield label.strip().lower(), key(label.strip().lower(), strip_marks), value.strip()


def mapped(text, best, aliases):
    """best: field -> (value, confidence) of the whole-text mapper."""
    found = matches(text)
    known = {}
    for _, k, v in pairs(text.splitlines(), True):
        if k and aliases.get(k, k) not in found:
            known[k] = (v, 0.6)
    known |= {k: (v[0], 0.6) for k, v in found.items()}
    for k, (v, c) in best.items():
        if k not in known or c > known[k][1]:
            known[k] = (v, c)
    for label, k, v in pairs(text.split("\n"), False):
        if len(k) > 1 and (label != k or k not in known):
            known[k] = (v, 0.5)
    return known


@pytest.mark.parametrize("seed", [1, 2])
def test_match_lines_against_python(spark, seed):
    texts = forms(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["field"]): (r["value"], round(r["confidence"], 6), r["pattern_idx"], r["line_idx"]) for r in extract.match_lines(docs).collect()}
    assert len(got) > 100 and got == {(i, f): v for i, t in enumerate(texts) if t for f, v in matches(t).items()}


def test_map_fields_against_python(spark):
    texts = forms(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    aliases = templates.aliases(templates.defaults(spark))
    table = {r["alias"]: r["canonical"] for r in aliases.collect()}
    best = {}
    for r in extract.extract_fields(docs).collect():
        best.setdefault(r["doc_id"], {})[r["field"]] = (r["value"], r["confidence"])
    got = {(r["doc_id"], r["field"]): (r["value"], round(r["confidence"], 6)) for r in extract.map_fields(docs, aliases).collect()}
    want = {(i, f): (v, round(c, 6)) for i, t in enumerate(texts) if t for f, (v, c) in mapped(t, best.get(i, {}), table).items()}
    assert {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {}


def test_one_scan_and_no_exchange(spark, tmp_path):
    spark.createDataFrame([(1, "Name: A B")], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    plan = extract.map_fields(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Python" not in plan

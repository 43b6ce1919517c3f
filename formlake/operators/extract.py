"""Text to fields: the whole-text mapper, the line matcher, generic label-value pairs, and their merger.

All steps work inside the row: arrays of candidates, of which the best of each field is picked by order. The merger too is a sort of a
row's own candidates by field and precedence, so an extraction reads its texts once and shuffles nothing. Every row of docs is a document
of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlake.functions import fixed
from formlake.functions.text import NO_CASE, PLAIN, collapse, first_group, java, normal_key, split_lines, strip
from formlake.operators.templates import available

FIELDS = {k: p for k, (p, _) in fixed.MAPPER_FIELDS.items()}

#: Words of which a text must hold one for a field's first, second, ... pattern to match; without an entry, none.
NEEDED = {
    "name": ["name", "applicant", "person"], "father_name": ["father", "father"], "mother_name": ["mother", "mother"], "date_of_birth": ["birth", "dob", "born"],
    "gender": ["sex gender"], "address": ["address", "residential", "permanent", "home"], "phone": ["phone mobile contact", "tel"], "email": ["mail"], "city": ["city", "town"],
    "state": ["state", "province"], "zip_code": ["zip postal pin"], "aadhaar_number": ["aadhaar aadhar uid"], "pan_number": ["pan"], "passport_number": ["passport"],
    "license_number": ["license licence dl"], "voter_id": ["voter epic"], "occupation": ["occupation", "profession"], "blood_group": ["blood", "blood"],
    "marital_status": ["marital"], "nationality": ["nationality"], "emergency_contact": ["emergency"],
}
_WORDS = {p: w.split() for k, words in NEEDED.items() for p, w in zip(FIELDS[k], words, strict=False)}

#: Words of which a line must hold one for a label of the line matcher to stand in it.
LABEL_WORDS = {
    "name": ["name"], "date_of_birth": ["b"], "id_number": ["id", "document"], "email": ["mail"], "phone": ["phone", "mobile", "contact"], "address": ["addr"],
    "aadhaar_number": ["aadha", "uid"], "pan_number": ["pan"], "passport_number": ["passport"], "license_number": ["licen", "dl"],
}
#: What else a line must hold: labels end in one of the marks, or are a phrase.
LABEL_ENDS = [":", "=", "is"]


def _low(text: Column) -> Column:
    """Small letters; as in patterns without case a long s counts as an s, dotted and dotless i as i."""
    return F.translate(F.lower(F.translate(text, "\u0130", "i")), "\u017f\u0131", "si")


def _holds(low: Column, words: list[str]) -> Column:
    found = low.contains(words[0])
    for w in words[1:]:
        found = found | low.contains(w)
    return found


def _searched(pattern: str) -> Column:
    """The pattern's first group in `text`, sought only where `low`, the text in small letters, holds a word that the pattern needs."""
    found = first_group(F.col("text"), pattern)
    words = _WORDS.get(pattern)
    if not words:
        return found
    return F.when(_holds(F.col("low"), words), found).otherwise("")


def available_fields(docs: DataFrame, templates: dict | None = None) -> DataFrame:
    """(doc_id, field) for each field with a pattern or a synonym in the text."""
    own = templates or fixed.MAPPER_FIELDS
    flags = F.array(*[F.when(available(F.col("text"), k, p, s), F.lit(k)) for k, (p, s) in own.items()])
    return docs.select("doc_id", F.explode(F.array_compact(flags)).alias("field"))


def clean_value(raw: Column) -> Column:
    """Single blanks, without blanks and colons at the ends."""
    return strip(F.btrim(collapse(strip(raw)), F.lit(":")))


def value_confidence(field: Column, value: Column) -> Column:
    """0 to 1: 0.7, more for longer and for clean values, less for values that look like another field's."""
    size = F.length(value)
    conf = F.lit(0.7).cast("double") + F.when(size > 2, 0.1).otherwise(0.0)
    conf = conf + F.when(size > 5, 0.1).otherwise(0.0)
    conf = conf + F.when(value.rlike(r"(?U)[^\w\s@.\-+()]"), 0.0).otherwise(0.1)
    address = conf - F.when(value.rlike(r"(?U)\d{10,}"), 0.3).otherwise(0.0)
    address = address - F.when(value.contains("@"), 0.2).otherwise(0.0)
    digits = F.length(F.regexp_replace(value, r"(?U)\D", "")) / F.greatest(size, F.lit(1))
    phone = conf - F.when(digits < 0.6, 0.3).otherwise(0.0)
    email = F.when(value.contains("@"), conf + 0.1).otherwise(0.0)
    conf = F.when(field == "address", address).when(field == "phone", phone).when(field == "email", email).otherwise(conf)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), conf))


def _rows(docs: DataFrame, column: str) -> DataFrame:
    """doc_id with a row for each struct of an array.

    An outer generator: for an inner one Spark infers a filter on the array's size, for which the array would be made once more."""
    return docs.select("doc_id", F.inline_outer(column)).where("field is not null")


def _with_best(docs: DataFrame, fields: dict[str, list[str]] | None = None) -> DataFrame:
    """docs (doc_id, text) with `best`: array of structs field, confidence, order (minus the pattern's number), value; one of each field found."""
    cands = [
        F.struct(F.lit(k).alias("field"), F.lit(i).alias("pattern_idx"), clean_value(_searched(p)).alias("value"))
        for k, patterns in (fields or FIELDS).items() for i, p in enumerate(patterns)
    ]
    # lateral: candidates are made and judged row by row, then the best of each field of a document is taken
    docs = docs.select("doc_id", "text", _low(F.col("text")).alias("low"))
    found = docs.select("doc_id", "text", F.filter(F.array(*cands), lambda c: c["value"] != "").alias("found"))
    scored = F.transform("found", lambda c: F.struct(c["field"].alias("field"), value_confidence(c["field"], c["value"]).alias("confidence"), (-c["pattern_idx"]).alias("order"), c["value"].alias("value")))
    scored = found.select("doc_id", "text", F.filter(scored, lambda c: c["confidence"] > 0).alias("scored"))
    best = F.filter("scored", lambda c: ~F.exists("scored", lambda o: (o["field"] == c["field"]) & ((o["confidence"] > c["confidence"]) | ((o["confidence"] == c["confidence"]) & (o["order"] > c["order"])))))
    return scored.select("doc_id", "text", best.alias("best"))


def extract_fields(docs: DataFrame, fields: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, field, value, confidence, pattern_idx): each field's best value in the text; the earliest pattern wins ties."""
    rows = _rows(_with_best(docs, fields), "best")
    return rows.select("doc_id", "field", "value", "confidence", (-F.col("order")).alias("pattern_idx"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_idx, line, next_line) of each line of each text."""
    lines = docs.select("doc_id", split_lines(F.col("text")).alias("lines"))
    each = F.transform("lines", lambda x, i: F.struct(i.alias("line_idx"), x.alias("line"), F.get("lines", i + 1).alias("next_line")))
    return lines.select("doc_id", F.inline(each))


def match_confidence(value: Column, value_pattern: str | None) -> Column:
    conf = F.lit(0.5).cast("double")
    if value_pattern:
        conf = conf + F.when(value.rlike(java("^(?:" + value_pattern + ")")), 0.3).otherwise(0.0)
    conf = conf + F.when(F.length(value) > 2, 0.1).otherwise(0.0)
    conf = conf + F.when(value.rlike(r"(?U)^[^\w\s]+$"), 0.0).otherwise(0.1)
    return F.least(F.lit(1.0), conf)


def _line_structs(text: Column) -> Column:
    """array<struct<line_idx, line, low>> of the text's lines."""
    return F.transform(split_lines(text), lambda x, i: F.struct(i.alias("line_idx"), x.alias("line"), _low(x).alias("low")))


def _best_match(field: str, labels: list[str], value_patterns: list[str]) -> Column:
    """struct<field, b: struct<minus (confidence), pattern_idx, line_idx, value_idx, below, value>> of the field's best value in `marked` lines.

    In passes over arrays, each made from the one before, so that no pattern is tried twice."""
    words = LABEL_WORDS.get(field) if fixed.MATCHER_FIELDS.get(field, [None])[0] == labels else None
    seen = F.filter("marked", lambda x: _holds(x["low"], words)) if words else F.col("lines")

    def labelled(x: Column) -> Column:
        def rest(i: int, label: str) -> Column:
            behind = strip(F.regexp_extract(x["line"], java("^(?s:.*?)(?:" + label + r")((?s:.*))$", NO_CASE), 1))
            return F.when(x["line"].rlike(java(label, NO_CASE)), F.struct(F.lit(i).alias("pattern_idx"), x["line_idx"].alias("line_idx"), behind.alias("rest")))

        return F.array_compact(F.array(*[rest(i, label) for i, label in enumerate(labels)]))

    def values(h: Column) -> Column:
        def value(k: int, below: int, text: Column) -> Column:
            return F.struct(h["pattern_idx"].alias("pattern_idx"), h["line_idx"].alias("line_idx"), F.lit(k).alias("value_idx"), F.lit(below).alias("below"), text.alias("value"))

        own = [value(k, 0, strip(F.regexp_extract(h["rest"], java(v, PLAIN), 1))) for k, v in enumerate(value_patterns)] or [value(0, 0, h["rest"])]
        next_line = F.when(h["rest"] == "", value(99, 1, strip(F.coalesce(F.get("lines", h["line_idx"] + 1)["line"], F.lit("")))))
        return F.array_compact(F.array(*own, next_line))

    def judged(c: Column) -> Column:
        confidence = match_confidence(c["value"], None)
        for k, v in enumerate(value_patterns):
            confidence = F.when(c["value_idx"] == k, match_confidence(c["value"], v)).otherwise(confidence)
        return F.struct((-confidence).alias("minus"), *[c[x].alias(x) for x in ("pattern_idx", "line_idx", "value_idx", "below", "value")])

    found = F.filter(F.flatten(F.transform(F.flatten(F.transform(seen, labelled)), values)), lambda c: c["value"] != "")
    return F.struct(F.lit(field).alias("field"), F.array_min(F.transform(found, judged)).alias("b"))


def _with_matches(rows: DataFrame, fields: dict | None = None, threshold: float = fixed.MATCHER_THRESHOLD) -> DataFrame:
    """rows (text, ...) with `matched`: array of structs field, value, confidence, pattern_idx, line_idx by labels at lines, one of each field found.

    Only lines that hold a label's end see any label, and of these only those that hold a word of the label see its patterns; templates that aren't
    built in (without words) see all lines."""
    own = fields or fixed.MATCHER_FIELDS
    rows = rows.withColumn("lines", _line_structs(F.col("text")))
    rows = rows.withColumn("marked", F.filter("lines", lambda x: _holds(x["low"], LABEL_ENDS)))
    best = [_best_match(field, labels, value_patterns) for field, (labels, value_patterns, _) in own.items() if labels]
    rows = rows.withColumn("matched", F.filter(F.array(*best), lambda m: -m["b"]["minus"] >= threshold))
    found = F.transform("matched", lambda m: F.struct(m["field"].alias("field"), m["b"]["value"].alias("value"), (-m["b"]["minus"]).alias("confidence"), m["b"]["pattern_idx"].alias("pattern_idx"), (m["b"]["line_idx"] + m["b"]["below"]).alias("line_idx")))
    return rows.withColumn("matched", found).drop("marked")


def match_lines(docs: DataFrame, fields: dict | None = None, threshold: float = fixed.MATCHER_THRESHOLD) -> DataFrame:
    """(doc_id, field, value, confidence, pattern_idx, line_idx) by labels at lines; the first of equal confidence wins."""
    return _rows(_with_matches(docs.select("doc_id", "text"), fields, threshold), "matched")


def matched_fields(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, field): the fields that the line matcher finds."""
    return match_lines(docs, **options).select("doc_id", "field").distinct()


def partial_fields(docs: DataFrame, names: list[str] | None = None, **options) -> DataFrame:
    """One row a document with a match: map field -> value of the matched fields, of those named only if names are given."""
    found = match_lines(docs, **options)
    found = found if names is None else found.where(F.col("field").isin(names))
    ordered = F.array_sort(F.collect_list(F.struct("field", "value")))
    return found.groupBy("doc_id").agg(F.map_from_entries(ordered).alias("fields"))


def pair_values(texts: DataFrame, column: str = "text", **options) -> DataFrame:
    """partial_fields of a table of single texts, each a document of its own, numbered."""
    return partial_fields(texts.select(F.monotonically_increasing_id().alias("doc_id"), F.col(column).alias("text")), None, **options)


def label_lines(docs: DataFrame, ends: str = r"\n") -> DataFrame:
    """(doc_id, line_idx, label, value) of lines with a colon and something behind it, cut at the first colon."""
    lines = F.split("text", ends, -1) if ends == r"\n" else split_lines(F.col("text"))
    rows = docs.select("doc_id", F.posexplode(lines).alias("line_idx", "line")).where(F.col("line").contains(":"))
    at = F.instr("line", ":")
    value = strip(F.substring("line", at + 1, F.length("line")))
    return rows.select("doc_id", "line_idx", F.lower(strip(F.substring("line", F.lit(1), at - 1))).alias("label"), value.alias("value")).where("value <> ''")


def generic_pairs(docs: DataFrame, matched: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, field, value, confidence 0.6): label-value lines whose canonical field isn't matched; the last line of a label wins."""
    rows = label_lines(docs, "all").withColumn("field", normal_key(F.col("label"))).where("field <> ''")
    rows = rows.join(aliases, F.col("field") == F.col("alias"), "left").withColumn("canonical", F.coalesce("canonical", "field"))
    left = rows.join(matched.select("doc_id", F.col("field").alias("canonical")), ["doc_id", "canonical"], "left_anti")
    return left.groupBy("doc_id", "field").agg(F.max_by("value", "line_idx").alias("value")).withColumn("confidence", F.lit(0.6).cast("double"))


def _pairs(lines: Column, strip_marks: bool) -> Column:
    """array<struct<line_idx, label, field, value>> of an array of lines: those with a colon and something behind it, cut at the first colon."""
    def pair(line: Column, i: Column) -> Column:
        at = F.instr(line, ":")
        label = F.lower(strip(F.substring(line, F.lit(1), at - 1)))
        return F.struct(i.alias("line_idx"), label.alias("label"), normal_key(label, strip_marks).alias("field"), strip(F.substring(line, at + 1, F.length(line))).alias("value"))

    found = F.transform(lines, lambda line, i: F.when(line.contains(":"), pair(line, i)))
    return F.filter(F.array_compact(found), lambda p: p["value"] != "")


def _entry(field: Column, rank: int, order: Column, tie: Column | int, value: Column, confidence: Column) -> Column:
    tie = F.lit(tie) if isinstance(tie, int) else tie
    return F.struct(field.alias("field"), F.lit(rank).alias("rank"), order.cast("double").alias("order"), tie.cast("int").alias("tie"), value.alias("value"), confidence.cast("double").alias("confidence"))


def map_fields(docs: DataFrame, aliases: DataFrame | None = None, fields: dict[str, list[str]] | None = None, use_matcher: bool = True, field_names: list[str] | None = None) -> DataFrame:
    """(doc_id, field, value, confidence) by all three ways, merged.

    The line matcher and its pairs count 0.6; the whole-text mapper replaces where it is surer; then label lines: the last one
    whose label isn't its own key overwrites, else what is there stays, else the first one fills in (both at 0.5).

    Everything that a document offers for a field becomes an entry (field, rank, order within the rank, value, confidence) of one array in
    its row; sorted, each field's first entry is its result."""
    own = {k: p for k, p in (fields or FIELDS).items() if field_names is None or k in field_names}
    rows = _with_best(docs, own)
    entries = [F.transform("best", lambda b: _entry(b["field"], 1, -b["confidence"], 2, b["value"], b["confidence"]))]
    half = F.lit(0.5)
    if use_matcher:
        rows = _with_matches(rows)
        sure = F.lit(0.6)
        entries.append(F.transform("matched", lambda m: _entry(m["field"], 1, -sure, 0, m["value"], sure)))
        if aliases is not None:
            known = aliases.agg(F.map_from_entries(F.collect_list(F.struct("alias", "canonical"))).alias("m")).scalar()
            rows = rows.withColumn("known", known).withColumn("taken", F.transform("matched", lambda m: m["field"]))
            rows = rows.withColumn("generic", _pairs(F.transform("lines", lambda x: x["line"]), True))
            free = F.filter("generic", lambda p: (p["field"] != "") & ~F.array_contains("taken", F.coalesce(F.try_element_at("known", p["field"]), p["field"])))
            rows = rows.withColumn("generic", F.array_sort(F.transform(free, lambda p: F.struct(p["field"].alias("field"), (-p["line_idx"]).alias("up"), p["value"].alias("value")))))
            last = F.filter("generic", lambda p, i: (i == 0) | (p["field"] != F.get("generic", i - 1)["field"]))
            entries.append(F.transform(last, lambda p: _entry(p["field"], 1, -sure, 1, p["value"], sure)))
    rows = rows.withColumn("pairs", F.filter(_pairs(F.split("text", r"\n", -1), False), lambda p: F.length(p["field"]) > 1))
    entries.append(F.transform("pairs", lambda p: F.when(p["label"] == p["field"], _entry(p["field"], 2, p["line_idx"], 0, p["value"], half)).otherwise(_entry(p["field"], 0, -p["line_idx"], 0, p["value"], half))))
    rows = rows.select("doc_id", F.array_sort(F.concat(*[F.coalesce(e, F.array()) for e in entries])).alias("e"))
    first = F.filter("e", lambda x, i: (i == 0) | (x["field"] != F.get("e", i - 1)["field"]))
    return _rows(rows.select("doc_id", first.alias("first")), "first").select("doc_id", "field", "value", "confidence")


def as_maps(fields: DataFrame) -> DataFrame:
    """One row a document: maps field -> value and field -> confidence, fields in order of name."""
    ordered = F.array_sort(F.collect_list(F.struct("field", "value", "confidence")))
    rows = fields.groupBy("doc_id").agg(ordered.alias("f"))
    return rows.select(
        "doc_id", F.map_from_entries(F.transform("f", lambda x: F.struct(x["field"], x["value"]))).alias("fields"),
        F.map_from_entries(F.transform("f", lambda x: F.struct(x["field"], x["confidence"]))).alias("confidences"))


def join_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text) of pages (doc_id, page_idx, text): those with text, in order of page, an empty line between."""
    full = pages.where(F.coalesce(strip(F.col("text")), F.lit("")) != "")
    texts = F.array_sort(F.collect_list(F.struct("page_idx", "text")))
    return full.groupBy("doc_id").agg(F.array_join(F.transform(texts, lambda p: p["text"]), "\n\n").alias("text"))


def summary(fields: DataFrame) -> DataFrame:
    """Number of documents and mean confidence of each field."""
    return fields.groupBy("field").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def with_rank(fields: DataFrame, n: int) -> DataFrame:
    """The n most frequent values of each field."""
    counts = fields.groupBy("field", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= n)

"""Registered queries over the test tables, with SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.functions import fixed, text, validate
from formlake.functions.scratch import Table, new_folder
from formlake.functions.similarity import strategy
from formlake.operators import classify, extract, extraction, forms, graph, layout, metrics, route, templates, verify
from formlake.sources import files

#: Customers rendered as label: value forms; the same text in both engines.
FORMS = """
select c.c_custkey as doc_id,
 concat_ws(chr(10),
  case when c.c_custkey % 4 = 1 then concat('Name:', chr(10), p.nm) else concat('Full Name: ', p.nm) end,
  case when c.c_custkey % 4 = 3 then concat('Father', chr(39), 's Name: ', p.nm) end,
  concat('Date of Birth: ', lpad(cast(1 + c.c_custkey % 28 as string), 2, '0'), '/', lpad(cast(1 + c.c_custkey % 12 as string), 2, '0'), '/', cast(1960 + c.c_custkey % 40 as string)),
  case when c.c_custkey % 4 <> 2 then concat('Phone: ', cast(9000000000 + c.c_custkey as string)) end,
  concat('Email: user', cast(c.c_custkey as string), '@example.com'),
  concat('PAN: ABCDE', lpad(cast(c.c_custkey % 10000 as string), 4, '0'), 'F'),
  concat('Address: ', cast(c.c_custkey as string), ' ', n.n_name, ' Road')) as text
from {customer} c
join {nation} n on c.c_nationkey = n.n_nationkey
join (select p_partkey, concat(upper(substr(split_part(p_name, ' ', 1), 1, 1)), substr(split_part(p_name, ' ', 1), 2), ' ',
   upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2)) as nm from {part}) p on p.p_partkey = c.c_custkey
"""
FORMS_CTE = "forms as (" + FORMS.format(customer="customer", nation="nation", part="part").replace("as string)", "as varchar)") + ")"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def form_docs(spark: SparkSession, d: str) -> DataFrame:
    """The forms, dealt over the cores: a form is a few hundred bytes, but every one goes through some eighty patterns."""
    docs = spark.sql(FORMS.format(customer="{customer}", nation="{nation}", part="{part}"), **{n: table(spark, d, n) for n in ("customer", "nation", "part")})
    return docs.repartition(spark.sparkContext.defaultParallelism, "doc_id")


def submitted_values(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, field, submitted): exact, in other case, under another key, and under a key that no document has."""
    docs = extract.extract_fields(form_docs(spark, d), _PLAIN_FIELDS)
    kind = F.col("doc_id") % 5
    field = F.when(kind == 3, F.upper("field")).when(kind == 4, F.concat(F.lit("zz_"), F.col("field"))).otherwise(F.col("field"))
    return docs.select("doc_id", field.alias("field"), F.col("value").alias("submitted"))


QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Fields whose patterns have no look-around, which DuckDB's expressions lack.
_PLAIN_FIELDS = {k: p for k, p in extract.FIELDS.items() if k not in ("address", "phone")}


def _best_sql(source: str, fields: dict[str, list[str]]) -> str:
    """Best value of each field and document: highest confidence, then earliest pattern."""
    one = " union all ".join(
        f"select doc_id, '{k}' as field, {i} as idx, regexp_extract(text, '(?im)" + p.replace("'", "''") + "', 1) as raw from " + source for k, ps in fields.items() for i, p in enumerate(ps))
    return f"""cand as ({one}), val as (select doc_id, field, idx, trim(trim(trim(regexp_replace(raw, '\\s+', ' ', 'g')), ':')) as value from cand where raw <> ''),
  conf as (select *, least(1.0::double, greatest(0.0::double, 0.7::double + case when length(value) > 2 then 0.1::double else 0 end + case when length(value) > 5 then 0.1::double else 0 end
    + case when regexp_matches(value, '[^\\p{{L}}\\p{{N}}_\\s@.\\-+()]') then 0 else 0.1::double end + case when field = 'email' then 0.1::double else 0 end)) as confidence from val where value <> ''),
  best as (select *, row_number() over (partition by doc_id, field order by confidence desc, idx) as r from conf)"""


_FOUND = "select doc_id, field, value, round(confidence, 6) as confidence from best where r = 1"


@query(f"with {FORMS_CTE}, {_best_sql('forms', _PLAIN_FIELDS)} {_FOUND}")
def field_values_forms(spark, d):
    found = extract.extract_fields(form_docs(spark, d), _PLAIN_FIELDS)
    return found.select("doc_id", "field", "value", F.round("confidence", 6).alias("confidence"))


@query(f"with {_best_sql('documents', _PLAIN_FIELDS)} select field, count(*) as n, round(avg(confidence), 6) as mean_confidence from best where r = 1 group by field")
def field_summary_documents(spark, d):
    return extract.summary(extract.extract_fields(table(spark, d, "documents"), _PLAIN_FIELDS))


@query(f"with {FORMS_CTE}, {_best_sql('forms', _PLAIN_FIELDS)} select field, count(*) as n, round(avg(confidence), 6) as mean_confidence from best where r = 1 group by field")
def field_summary_forms(spark, d):
    return extract.summary(extract.extract_fields(form_docs(spark, d), _PLAIN_FIELDS))


@query()
def field_values_all(spark, d):
    """All fields of documents, forms' quirks with look-around included (no SQL: RE2 has no look-around)."""
    return extract.extract_fields(table(spark, d, "documents"))


_PLAIN_TEMPLATES = {k: fixed.MAPPER_FIELDS[k] for k in _PLAIN_FIELDS}


def _available_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    one = []
    for k, (patterns, synonyms) in _PLAIN_TEMPLATES.items():
        tests = [f"regexp_matches(t, {quoted('(?im)' + p)})" for p in patterns] + [f"contains(t, {quoted(w.lower())})" for w in synonyms]
        one.append(f"select doc_id, '{k}' as field from low where " + " or ".join(tests))
    return " union all ".join(one)


@query(f"with {FORMS_CTE}, low as (select doc_id, lower(text) as t from forms) {_available_sql()}")
def available_fields_forms(spark, d):
    return extract.available_fields(form_docs(spark, d), _PLAIN_TEMPLATES)


_LABELS = """pairs as (select doc_id, ord as line_idx, lower(trim(substr(line, 1, instr(line, ':') - 1))) as label, trim(substr(line, instr(line, ':') + 1)) as value
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord from forms) where instr(line, ':') > 0),
  keyed as (select *, regexp_replace(regexp_replace(label, '[^\\w\\s]', '', 'g'), '\\s+', '_', 'g') as field from pairs where value <> '')"""


@query(f"with {FORMS_CTE}, {_LABELS} select doc_id, cast(line_idx as integer) as line_idx, field, value from keyed where field <> ''")
def label_lines_forms(spark, d):
    return extract.label_lines(form_docs(spark, d)).withColumn("field", text.normal_key(F.col("label"))).where("field <> ''").select("doc_id", "line_idx", "field", "value")


@query(f"with {FORMS_CTE}, {_LABELS} select field, count(*) as n, min(value) as least, max(value) as most from (select doc_id, field, arg_max(value, line_idx) as value from keyed where field <> '' group by 1, 2) group by field")
def last_pairs_forms(spark, d):
    rows = extract.label_lines(form_docs(spark, d)).withColumn("field", text.normal_key(F.col("label"))).where("field <> ''")
    last = rows.groupBy("doc_id", "field").agg(F.max_by("value", "line_idx").alias("value"))
    return last.groupBy("field").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


@query()
def match_lines_forms(spark, d):
    return extract.match_lines(form_docs(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query()
def map_fields_forms(spark, d):
    aliases = templates.aliases(templates.defaults(spark))
    return extract.map_fields(form_docs(spark, d), aliases).withColumn("confidence", F.round("confidence", 6))


def _all_texts(spark, d) -> DataFrame:
    return form_docs(spark, d).unionByName(table(spark, d, "documents").select((F.col("doc_id") + 10000000).alias("doc_id"), "text"))


_TEMPLATES = [("mapper", k, p, [], s) for k, (p, s) in fixed.MAPPER_FIELDS.items()] + [("matcher", k, p, v, s) for k, (p, v, s) in fixed.MATCHER_FIELDS.items()]
_TEMPLATES_SQL = "(values " + ", ".join(
    f"('{r}', '{k}', {len(p)}, {len(v)}, {len(s)}, [" + ", ".join("'" + x.lower().replace("'", "''") + "'" for x in s) + "]::varchar[])" for r, k, p, v, s in _TEMPLATES
) + ") t(registry, name, n_patterns, n_value_patterns, n_synonyms, synonyms)"


@query(f"""with {FORMS_CTE}, low as (select lower(text) as x from forms union all select lower(text) from documents)
select registry, name, n_patterns, n_value_patterns, n_synonyms, false as required, count(*) over (partition by registry) as n_templates,
 (select count(*) from low where len(list_filter(t.synonyms, lambda s: contains(x, s))) > 0) as n_docs from {_TEMPLATES_SQL}""")
def template_schema(spark, d):
    """The templates, and in how many forms and documents a synonym of each stands."""
    own = templates.defaults(spark)
    return templates.schema_export(own).join(templates.synonym_hits(_all_texts(spark, d), own), ["registry", "name"])


@query(f"""with {FORMS_CTE}, docs as (select doc_id, text from forms union all select doc_id + 10000000, text from documents),
l as (select doc_id, string_split(text, chr(10)) as ls from docs), x as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as i from l),
f as (select doc_id, i, 'father_name' as field, 0.5::double as c, trim(regexp_extract(line, '(?i)^\\s*father''s\\s+name\\s*:\\s*(.*)$', 1)) as value from x
  union all select doc_id, i, 'mail_user', 0.8::double, regexp_extract(line, '(?i)^\\s*email\\s*:\\s*.*?(user[0-9]+)@', 1) from x),
s as (select doc_id, i, field, value, c + case when length(value) > 2 then 0.1 else 0 end + case when regexp_matches(value, '^[^\\w\\s]+$') then 0 else 0.1 end as confidence from f where value <> ''),
b as (select *, row_number() over (partition by doc_id, field order by confidence desc, i) as r from s)
select doc_id, field, value, cast(i as integer) as line_idx, round(least(1.0::double, confidence), 6)::double as confidence from b where r = 1""")
def match_lines_learnt(spark, d):
    """Forms and documents by a table of templates of which one was added, added anew as a second version, and one learnt from a pattern."""
    own = templates.defaults(spark).where("name = ''")
    own = templates.add(own, "matcher", "mail_user", [r"(?:^|\n)\s*e-post\s*[:]\s*"], [r"(user)"], version=1)
    own = templates.add(own, "matcher", "mail_user", [r"(?:^|\n)\s*email\s*[:]\s*"], [r"(user[0-9]+)"], version=2)
    own = templates.learn(own, "father_name", r"(?:^|\n)\s*father's\s+name\s*[:]\s*")
    return templates.match(_all_texts(spark, d), own).select("doc_id", "field", "value", "line_idx", F.round("confidence", 6).alias("confidence"))


def _type_sql() -> str:
    scores = []
    for order, (kind, (words, least, _)) in enumerate(fixed.DOCUMENT_TYPES.items()):
        hits = " + ".join("cast(regexp_matches(t, '" + w.replace("'", "''") + "') as integer)" for w in words)
        scores.append(f"select doc_id, '{kind}' as kind, {order} as ord, {least}::double as least, ({hits}) / {len(words)}::double as conf from low")
    return " union all ".join(scores)


@query(f"""with {FORMS_CTE}, low as (select doc_id, lower(text) as t from forms union all select doc_id + 10000000, lower(text) from documents), s as ({_type_sql()}),
b as (select *, row_number() over (partition by doc_id order by conf desc, ord) as r from s)
select doc_id, case when conf >= least then kind else 'generic' end as doc_type, round(conf, 6) as confidence from b where r = 1""")
def classify_texts(spark, d):
    docs = form_docs(spark, d).unionByName(table(spark, d, "documents").select((F.col("doc_id") + 10000000).alias("doc_id"), "text"))
    kind = classify.classify_text(F.col("text"))
    return docs.select("doc_id", kind.alias("k")).select("doc_id", "k.doc_type", F.round("k.confidence", 6).alias("confidence"))


_SPANS = " ".join(f"when '{k}' then {s[0]}::double" for k, (_, _, s) in fixed.DOCUMENT_TYPES.items() if s), " ".join(f"when '{k}' then {s[1]}::double" for k, (_, _, s) in fixed.DOCUMENT_TYPES.items() if s)


@query(f"""with {FORMS_CTE}, low as (select doc_id, lower(text) as t from forms), s as ({_type_sql()}),
b as (select *, row_number() over (partition by doc_id order by conf desc, ord) as r from s),
k as (select doc_id, case when conf >= least then kind else 'generic' end as doc_type, conf, (100 + p_size) / 90::double as aspect from b join part on p_partkey = doc_id where r = 1),
w as (select *, case doc_type {_SPANS[0]} end as lo, case doc_type {_SPANS[1]} end as hi from k)
select doc_id, doc_type, round(case when doc_type = 'generic' then case when aspect between 1.5 and 1.7 then 0.3 else 0 end when lo is null then conf
  when aspect between lo and hi then least(1.0, conf * 1.2::double) else conf * 0.8::double end, 6)::double as confidence from w""")
def classify_with_shape(spark, d):
    rows = form_docs(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") + 100).alias("width")), "doc_id")
    kind = classify.classify_shape(F.col("text"), F.col("width"), F.lit(90.0))
    return rows.select("doc_id", kind.alias("k")).select("doc_id", "k.doc_type", F.round("k.confidence", 6).alias("confidence"))


@query(f"""with {FORMS_CTE}, low as (select doc_id, lower(text) as t from forms union all select doc_id + 10000000, lower(text) from documents), s as ({_type_sql()}),
b as (select *, row_number() over (partition by doc_id order by conf desc, ord) as r from s), k as (select doc_id, case when conf >= least then kind else 'generic' end as doc_type from b where r = 1)
select doc_id, doc_type, n.ord, field from k join (values """ + ", ".join(f"('{k}', {i}, '{f}')" for k, own in fixed.RECOMMENDED.items() for i, f in enumerate(own)) + ") n(kind, ord, field) on doc_type = n.kind")
def recommended_fields(spark, d):
    """What fields each form and document should have by its own type."""
    kinds = _all_texts(spark, d).select("doc_id", classify.classify_text(F.col("text"))["doc_type"].alias("doc_type"))
    return kinds.select("doc_id", "doc_type", F.posexplode(classify.recommended_fields(F.col("doc_type"))).alias("ord", "field"))


@query(f"""with {FORMS_CTE}, docs as (select doc_id, text from forms union all select doc_id + 10000000, text from documents), low as (select doc_id, lower(text) as t from docs)
select doc_id, case when regexp_matches(t, 'aadhaar|pan\\s+card|voter\\s+id|driving\\s+licen[cs]e|drl\\s+no') then
    case when contains(t, 'aadhaar') or contains(t, 'aadhar') then 'id_card' when contains(t, 'driving') or contains(t, 'drl') then 'driver_license' else 'id_card' end
  when contains(t, 'passport') then 'passport' when regexp_matches(t, 'certificate|this\\s+is\\s+to\\s+certify|degree|diploma') then 'certificate'
  when regexp_matches(t, 'application\\s+form|registration\\s+form|form\\s+no') then 'form' when regexp_matches(t, 'invoice|bill\\s+no') then 'invoice'
  when regexp_matches(t, 'receipt|payment') then 'receipt' else 'unknown' end as doc_type from low""")
def classify_by_rules(spark, d):
    docs = form_docs(spark, d).unionByName(table(spark, d, "documents").select((F.col("doc_id") + 10000000).alias("doc_id"), "text"))
    return docs.select("doc_id", classify.by_rules(F.col("text")).alias("doc_type"))


@query(f"""with {FORMS_CTE} select doc_id, 'pan_number' as key, regexp_extract(text, '([A-Z]{{5}}\\d{{4}}[A-Z])', 1) as value from forms where regexp_matches(text, '[A-Z]{{5}}\\d{{4}}[A-Z]')
union all select doc_id, 'aadhaar_number', replace(regexp_extract(text, '(\\d{{4}}\\s?\\d{{4}}\\s?\\d{{4}})', 1), ' ', '') from forms where regexp_matches(text, '\\d{{4}}\\s?\\d{{4}}\\s?\\d{{4}}')""")
def id_metadata(spark, d):
    return classify.metadata(form_docs(spark, d).withColumn("doc_type", F.lit("id_card")))


_CHECKS = """select c_custkey as doc_id, field, value from (
  select c_custkey, 'email' as field, case when c_custkey % 3 = 0 then 'bad mail' else concat('user', c_custkey, '@example.com') end as value from {customer}
  union all select c_custkey, 'mobile', case when c_custkey % 4 = 0 then '+91 12' else concat('(900) 000-', 1000 + c_custkey % 9000) end from {customer}
  union all select c_custkey, 'aadhaar', concat('1234 5678 ', case when c_custkey % 5 = 0 then '90' else '9012' end) from {customer}
  union all select c_custkey, 'pan', case when c_custkey % 2 = 0 then 'abcde1234f' else 'ABC 12' end from {customer}
  union all select c_custkey, 'remarks', case when c_custkey % 7 = 0 then ' ' else 'x' end from {customer}
  union all select c_custkey, 'dob', concat(c_custkey % 40, case when c_custkey % 2 = 0 then '/' else '-' end, 1 + c_custkey % 12, case when c_custkey % 2 = 0 then '/' else '-' end, case when c_custkey % 3 = 0 then cast(1960 + c_custkey % 40 as varchar(4)) else lpad(cast(c_custkey % 100 as varchar(3)), 2, '0') end) from {customer}) v"""


@query("with v as (" + _CHECKS.format(customer="customer") + """), dated as (select *, strftime(case when regexp_matches(value, '[/-]\\d{4}$') then coalesce(try_strptime(value, '%d/%m/%Y'), try_strptime(value, '%d-%m-%Y')) else coalesce(try_strptime(value, '%d/%m/%y'), try_strptime(value, '%d-%m-%y')) end, '%Y-%m-%d') as iso from v)
select doc_id, field, value, case when field = 'dob' then iso end as iso,
 case when trim(value) = '' then 'Field is empty' when field = 'dob' then case when iso is null then 'Invalid date format' end
  when field = 'email' then case when not regexp_matches(value, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') then 'Invalid email format' end
  when field = 'mobile' then case when not regexp_matches(regexp_replace(value, '[\\s\\-()]', '', 'g'), '^\\d{10,15}$') then 'Invalid phone number format' end
  when field = 'aadhaar' then case when not regexp_matches(regexp_replace(value, '\\s', '', 'g'), '^\\d{12}$') then 'Invalid Aadhaar number format' end
  when field = 'pan' then case when not regexp_matches(regexp_replace(upper(value), '\\s', '', 'g'), '^[A-Z]{5}\\d{4}[A-Z]$') then 'Invalid PAN format' end end as error from dated""")
def validate_values(spark, d):
    rows = spark.sql(_CHECKS, customer=table(spark, d, "customer"))
    return rows.select("doc_id", "field", "value", F.when(F.col("field") == "dob", validate.iso_date(F.col("value"))).alias("iso"), validate.error(F.col("field"), F.col("value")).alias("error"))


_SUBMITTED = f"""{_best_sql('forms', _PLAIN_FIELDS)}, have as (select doc_id, field, value from best where r = 1),
  sub as (select doc_id, case doc_id % 5 when 3 then upper(field) when 4 then 'zz_' || field else field end as field, value as submitted from have),
  res as (select s.doc_id, s.field, s.submitted, h.value as extracted, case when h.value is null then 0.0::double else 1.0::double end as similarity,
    case when h.value is null then 'not_found' else 'match' end as status from sub s left join have h on h.doc_id = s.doc_id and (h.field = lower(s.field)))"""


def _verified(spark, d) -> DataFrame:
    have = extract.extract_fields(form_docs(spark, d), _PLAIN_FIELDS)
    return verify.verify(submitted_values(spark, d), have.select("doc_id", "field", "value"), fuzzy=False)


@query(f"with {FORMS_CTE}, {_SUBMITTED} select * from res")
def verify_keys(spark, d):
    return _verified(spark, d)


@query(f"with {FORMS_CTE}, {_SUBMITTED} select doc_id, avg(similarity) as overall_confidence from res group by doc_id")
def verify_overall(spark, d):
    return verify.overall(_verified(spark, d))


@query(f"""with {FORMS_CTE}, {_SUBMITTED} select doc_id, cast(count(*) filter (status = 'match') as bigint) as match, 0::bigint as partial, 0::bigint as mismatch,
 cast(count(*) filter (status = 'not_found') as bigint) as not_found, cast(round(avg(similarity) * 100) as bigint) as mean_percent from res group by doc_id""")
def verify_counts(spark, d):
    return metrics.status_counts(_verified(spark, d))


@query()
def verify_fuzzy(spark, d):
    """Names with swapped words and keys alike but for a prefix (no SQL: ratios of common subsequences)."""
    have = Table(extract.extract_fields(form_docs(spark, d)).select("doc_id", "field", "value")).df  # read by both sides
    words = F.split("value", " ")
    sent = have.select("doc_id", F.when(F.col("doc_id") % 5 == 4, F.concat(F.lit("my_"), F.col("field"))).otherwise(F.col("field")).alias("field"), F.array_join(F.reverse(words), " ").alias("submitted"))
    return verify.verify(sent, have)


@query("""select event_type as doc_id, avg(s) as mean_similarity, avg(case when s >= 0.9 then 1.0 else 0.0 end)::double as match_rate, avg(case when s >= 0.6 and s < 0.9 then 1.0 else 0.0 end)::double as partial_rate,
 avg(case when s < 0.6 then 1.0 else 0.0 end)::double as mismatch_rate from (select event_type, (event_id % 16) / 16::double as s from events) group by event_type""")
def similarity_rates(spark, d):
    return metrics.rates(table(spark, d, "events").select(F.col("event_type").alias("doc_id"), (F.col("event_id") % 16 / F.lit(16.0)).cast("double").alias("similarity")))


@query("""select l_orderkey as doc_id, round(case when coalesce(sum(w), 0) = 0 then avg(c) else sum(c * coalesce(w, 1)) / sum(w) end, 6) as overall
 from (select l_orderkey, l_discount as c, case when l_linenumber % 2 = 0 then l_linenumber::double end as w from lineitem) group by 1""")
def weighted_confidence(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_discount").alias("confidence"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("double")).alias("weight"))
    return metrics.overall_confidence(rows).select("doc_id", F.round("overall", 6).alias("overall"))


@query("""select event_type as engine, count(*) as total, count(*) filter (event_id % 10 <> 0) as success, count(*) filter (event_id % 10 = 0) as errors, round(avg(case when event_id % 10 <> 0 then (event_id % 100) / 100::double end), 6) as avg_similarity,
 min(case when event_id % 10 <> 0 then (event_id % 100) / 100::double end) as min_similarity, max(case when event_id % 10 <> 0 then (event_id % 100) / 100::double end) as max_similarity from events group by 1""")
def engine_stats(spark, d):
    bad = F.col("event_id") % 10 == 0
    rows = table(spark, d, "events").select(F.col("event_type").alias("engine"), F.when(bad, "failed").alias("error"), F.when(~bad, (F.col("event_id") % 100).cast("double") / 100).alias("similarity"))
    return metrics.engine_stats(rows).withColumn("avg_similarity", F.round("avg_similarity", 6))


@query("""select event_id as doc_id, round(case when trim(event_type) = '' then 0 else least(1.0::double, greatest(0.0::double, 0.7::double * ((event_id % 100) / 100::double) + 0.3::double * least(1.0::double, length(event_type) / 20::double))) end, 6) as confidence from events""")
def field_confidence(spark, d):
    rows = table(spark, d, "events")
    return rows.select(F.col("event_id").alias("doc_id"), F.round(metrics.field_confidence(F.col("event_type"), (F.col("event_id") % 100).cast("double") / 100, F.length("event_type")), 6).alias("confidence"))


def _filled_sql() -> str:
    key = lambda x: re.sub(r"[\\s_-]", "_", x.lower())
    names = ", ".join(f"('{k}', {i}, '{key(x)}')" for k, own in fixed.FORM_FIELDS.items() for i, x in enumerate(own))
    return f"""{_best_sql('forms', _PLAIN_FIELDS)}, v as ({_FOUND}),
  f as (select *, row_number() over (partition by doc_id, form_field order by ord, field) as place from v join (values {names}) n(form_field, ord, key) on n.key = v.field)"""


@query(f"""with {FORMS_CTE}, {_filled_sql()} select doc_id, form_field, value, confidence, case when confidence >= 0.8 then 'high' when confidence >= 0.6 then 'medium' else 'low' end as tier
from f where place = 1""")
def autofill(spark, d):
    found = extract.extract_fields(form_docs(spark, d), _PLAIN_FIELDS)
    filled = forms.fill(found.withColumn("confidence", F.round("confidence", 6)), forms.form_map(spark))
    return filled.select("doc_id", "form_field", "value", "confidence", "tier")


@query(f"with {FORMS_CTE}, {_filled_sql()} select doc_id, " + ", ".join(f"max(value) filter (form_field = '{k}') as {k}" for k in fixed.FORM_FIELDS) + " from f where place = 1 group by doc_id")
def autofill_wide(spark, d):
    return forms.fill_wide(extract.extract_fields(form_docs(spark, d), _PLAIN_FIELDS), forms.form_map(spark))


@query("select distinct p_type as key, array_to_string(list_transform(string_split(replace(p_type, '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') as title from part")
def field_titles(spark, d):
    return table(spark, d, "part").select(F.col("p_type").alias("key"), text.title(F.col("p_type")).alias("title")).distinct()


@query("""select doc_id, lang, case lang when 'en' then 'eng' else 'eng' end as recogniser, case when lang <> 'eng' then 'tesseract' end as engine from documents
union all select doc_id, 'eng', 'eng', case doc_id % 4 when 0 then 'printed' else 'handwritten' end from documents""")
def engine_routes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    rows = docs.unionByName(docs.withColumn("lang", F.lit("eng")))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("printed", "handwritten", "mixed", "unknown")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return rows.select("doc_id", "lang", route.recogniser_language(F.col("lang")).alias("recogniser"), route.choose_engine(F.col("lang"), kind).alias("engine"))


@query("select conv_id as doc_id, string_agg(text, chr(10) || chr(10) order by turn, text) as text from conversations where trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' group by conv_id")
def page_texts(spark, d):
    return extract.join_pages(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_idx"), "text"))


def _reader(patient: bool):
    """An engine for pages that are texts: gives the text back; if not patient, refuses those that hold a capital E."""

    def maker():
        def read(page):
            if not patient and "E" in (page["text"] or ""):
                raise ValueError("refused")
            return page["text"], 0.5

        return read

    return maker


@query("""select conv_id as doc_id, turn as page_idx, text, case role when 'user' then 'handwritten' else 'printed' end as engine, case when contains(coalesce(text, ''), 'E') then 2 else 1 end as tries
from conversations qualify row_number() over (partition by conv_id, turn order by case role when 'user' then 1 else 2 end, text nulls first) = 1""")
def page_states(spark, d):
    """Turns of conversations as pages, read by the engine of their kind: a first run that fails on some pages, and one that reads those only."""
    kind = F.when(F.col("role") == "user", "handwritten").otherwise("printed")
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_idx"), F.struct("text").alias("image"), kind.alias("text_kind"), F.lit("eng").alias("language"))
    path = new_folder(spark)
    for patient in (False, True):
        store = extraction.page_states(pages, path, {k: _reader(patient) for k in ("printed", "handwritten")}, mode="off", parts=spark.sparkContext.defaultParallelism)
    return store.latest().select("doc_id", "page_idx", "text", "engine", "tries")


@query("""select page_id, case when length(html) > 4000 then 'too_large' when length(coalesce(html, '')) = 0 then 'empty' end as reason,
 case when ends_with(lower(url), '.pdf') then 'pdf' when regexp_matches(url, '(?i)\\.(png|jpe?g|gif|bmp|tiff?|webp)$') then 'image' end as kind from pages""")
def upload_checks(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id", files.upload_error(F.length("html"), 4000).alias("reason"), files.file_kind(F.encode("html", "UTF-8"), F.col("url")).alias("kind"))


@query("select event_id as doc_id, k as field, json_extract_string(props, '$.' || k) as submitted from (select event_id, props, unnest(json_keys(props)) as k from events)")
def json_fields(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("fields_json"))
    return verify.parse_submitted(rows)[0]


@query("""with w as (select l_orderkey as doc_id, l_linenumber as i, l_returnflag as t, l_quantity - 5 as c from lineitem)
select doc_id, coalesce(string_agg(t, ' ' order by i, t, c) filter (c::int > 0), '') as text, round(coalesce(avg(c) filter (c::int > 0), 0) / 100, 6) as confidence from w group by doc_id""")
def word_confidence(spark, d):
    words = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_returnflag").alias("text"), (F.col("l_quantity") - 5).alias("conf")))).alias("w"))
    got = words.select("doc_id", metrics.word_confidence(F.transform("w", lambda x: F.struct(x["text"].alias("text"), x["conf"].alias("conf")))).alias("r"))
    return got.select("doc_id", "r.text", F.round("r.confidence", 6).alias("confidence"))


@query("""select l_orderkey as doc_id, string_agg(l_linenumber || ':' || l_suppkey, ',' order by l_linenumber, l_suppkey) as cells from lineitem group by 1""")
def cells_in_order(spark, d):
    cell = F.struct(F.col("l_suppkey").alias("x"), F.col("l_linenumber").alias("y"), F.lit(1).alias("w"), F.lit(1).alias("h"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(cell).alias("cells"))
    return rows.select("doc_id", F.array_join(F.transform(route.cells_in_order(F.col("cells")), lambda c: F.concat_ws(":", c["y"].cast("string"), c["x"].cast("string"))), ",").alias("cells"))


@query("""with p as (select event_id // 400 as doc_id, event_id % 400 as y, case when event_id % 400 % 50 < 20 + event_id // 400 % 5 then 100 else 0 end as ink from events),
f as (select *, case when ink > 50 then 1 else 0 end as on_ from p), t as (select *, case when on_ <> coalesce(lag(on_) over w, 0) then 1 else 0 end as turn from f window w as (partition by doc_id order by y)),
r as (select *, sum(turn) over (partition by doc_id order by y) as run from t), l as (select doc_id, max(y) as bottom from p group by 1),
g as (select doc_id, run, min(y) as y1, max(y) + 1 as y2 from r where on_ = 1 group by 1, 2)
select doc_id, y1, y2 from g join l using (doc_id) where y2 <= bottom and y2 - y1 > 12""")
def line_runs(spark, d):
    e = table(spark, d, "events")
    y, doc = F.col("event_id") % 400, F.floor(F.col("event_id") / 400)
    return route.line_runs(e.select(doc.alias("doc_id"), y.alias("y"), F.when(y % 50 < 20 + doc % 5, 100).otherwise(0).alias("ink")))


#: Customers as modules whose source imports in every form: names in a list, relative with one to three dots, indented, in a comment.
_SOURCES = """select concat('/src/app/g', c_custkey % 7, '/', case when c_custkey % 50 = 0 then '__init__' else concat('c', c_custkey) end, '.py') as path,
 concat_ws(chr(10), concat('import os, app.g', (c_custkey + 1) % 7, '.c', c_custkey + 1, ' as z'), '# import app.none', 'from . import a', concat('from .util', c_custkey % 3, ' import x, y'),
  'from ..shared.deep import s', 'from ...far import t', concat('    from app.core', c_nationkey, ' import (q)'), 'from os import path') as value from {customer}"""


@query("""with m as (select concat('app.g', c_custkey % 7, '.', case when c_custkey % 50 = 0 then '__init__' else concat('c', c_custkey) end) as src, c_custkey as k, c_nationkey as n from customer)
select distinct src, unnest([concat('app.g', (k + 1) % 7, '.c', k + 1), src, concat(src, '.util', k % 3), concat('app.g', k % 7, '.shared.deep'), concat('app.core', n)]) as dst from m""")
def import_scan(spark, d):
    """Import edges of a source text a customer, relative ones as surveyed. Customers are dealt over the cores, for a file's few bytes a customer become a text and its edges."""
    dealt = table(spark, d, "customer").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")
    return graph.scan_imports(spark.sql(_SOURCES, customer=dealt), "app")


#: Customers that import the customers numbered as their orders are, whole tables: about ten edges a module at every size.
_EDGES = "select distinct 'c' || o_custkey as src, 'c' || (o_orderkey % (select count(*) from {customer})) as dst from {orders}"


@query("with e as (" + _EDGES.format(customer="customer", orders="orders") + ") select dst, count(*) as n from e group by dst order by n desc, dst limit 10")
def import_hot_spots(spark, d):
    return graph.in_degree(spark.sql(_EDGES, customer=table(spark, d, "customer"), orders=table(spark, d, "orders")))


@query("select distinct src from (" + _EDGES.format(customer="customer", orders="orders") + ") where src = dst")
def import_self_loops(spark, d):
    return graph.self_loops(spark.sql(_EDGES, customer=table(spark, d, "customer"), orders=table(spark, d, "orders")))


#: Every order as a module that imports one of the same dozen of order numbers, some of them two: chains, loops, and loops that share modules.
_LINKS = """select 'o' || o_orderkey as src, 'o' || (o_orderkey - o_orderkey % 12 + (o_orderkey + 1 + o_custkey % 5) % 12) as dst from {orders}
union select 'o' || o_orderkey, 'o' || (o_orderkey - o_orderkey % 12 + (o_orderkey + 7) % 12) from {orders} where o_orderstatus <> 'O'"""


@query("with recursive e as (select distinct src, dst from (" + _LINKS.format(orders="orders") + """) where src <> dst),
r as (select src as a, dst as z from e union select a, e.dst from r join e on e.src = r.z),
s as (select x.a, x.z from r x join r y on x.a = y.z and x.z = y.a where x.a <> x.z)
select a as module, least(a, min(z)) as component from s group by a""")
def import_components(spark, d):
    """Strongly connected modules of a graph over all orders."""
    return graph.components(spark.sql(_LINKS, orders=table(spark, d, "orders")))


_FEW = "select distinct 'n' || n_nationkey as src, 'n' || ((n_nationkey * 7 + n_regionkey) % 25) as dst from {nation} union select 'n' || n_nationkey, 'n' || ((n_nationkey + 5) % 25) from {nation}"


@query("with recursive e as (select * from (" + _FEW.format(nation="nation") + """) where src <> dst),
p as (select src as a, dst as z, [src, dst] as path from e union all select a, e.dst, list_append(path, e.dst) from p join e on e.src = p.z where e.dst > a and not list_contains(path, e.dst))
select array_to_string(path, '>') as cycle from p join e on e.src = p.z and e.dst = p.a where p.a = list_min(path)""")
def import_cycles(spark, d):
    return graph.cycles(spark.sql(_FEW, nation=table(spark, d, "nation"))).select(F.array_join("cycle", ">").alias("cycle"))


def _regions_sql(boxes: str) -> str:
    """Regions of boxes b(doc_id, x1, y1, x2, y2, n) by reachability among equal boxes' representatives."""
    return f"""with recursive b as (select row_number() over (order by doc_id, y1, x1, y2, x2) as i, * from (select doc_id, x1, y1, x2, y2, count(*) as n from ({boxes}) group by all)),
l as (select p.i as a, q.i as z from b p join b q on p.doc_id = q.doc_id and p.x1 <= q.x2 and q.x1 <= p.x2 and p.y1 <= q.y2 and q.y1 <= p.y2),
r as (select a, z from l union select r.a, l.z from r join l on r.z = l.a), g as (select a, min(z) as root from r group by a)
select doc_id, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, sum(n)::bigint as n from b join g on g.a = b.i group by doc_id, root"""


#: A page for each order, with a box for each of its lines.
_BOXES = "select l_orderkey as doc_id, l_partkey % 60 as x1, l_suppkey % 60 as y1, l_partkey % 60 + 6 + l_orderkey % 20 as x2, l_suppkey % 60 + 6 + 2 * l_linenumber as y2 from {lineitem}"


@query(_regions_sql(_BOXES.format(lineitem="lineitem")))
def merged_boxes(spark, d):
    """Small boxes united wherever they touch."""
    return layout.regions(spark.sql(_BOXES, lineitem=table(spark, d, "lineitem")))


@query(_regions_sql("""select distinct doc_id, line_id, (x2 - length(piece))::bigint as x1, y1, x2::bigint as x2, y1 + 1 as y2 from (
 select *, sum(length(piece) + 1) over (partition by doc_id, y1, line_id order by k) - 1 as x2 from (
  select doc_id, y1, hash(line) as line_id, unnest(string_split_regex(line, '[.,;:!?]')) as piece, generate_subscripts(string_split_regex(line, '[.,;:!?]'), 1) as k from (
   select distinct doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as y1 from documents))) where piece <> ''"""))
def text_regions(spark, d):
    """Regions on the character grid of each document: clauses (between punctuation) that touch those of the lines above and below."""
    return layout.text_regions(table(spark, d, "documents"), "[.,;:!?]")


@query("select distinct o_orderpriority as field, 'default' as strategy from orders")
def similarity_strategies(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("field"), strategy(F.col("o_orderpriority")).alias("strategy")).distinct()


@query("""select field, value, n, rank from (select field, value, n, row_number() over (partition by field order by n desc, value) as rank from (
 select 'status' as field, o_orderstatus as value, count(*) as n from orders group by 2 union all select 'priority', o_orderpriority, count(*) from orders group by 2)) where rank <= 3""")
def top_values(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.explode(F.array(F.struct(F.lit("status").alias("field"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value")))).alias("f")).select("f.field", "f.value")
    return extract.with_rank(rows, 3)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

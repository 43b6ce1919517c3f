"""Token alignment against a plain double loop over whole texts, with texts of all odd kinds."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from formlake.llm import token_alignment as alignment

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def tokens(text):
    """(ids, spans) of both tokenizers for a whole text, None if the bytes differ."""
    a = Tokenizer.from_file(alignment.BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.MODEL)
    letters = alignment.byte_of_letter()
    spell_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out = []
    for ids, spell in ((a.encode(" " + text, add_special_tokens=False).ids, spell_a), (b.encode(text), spell_b)):
        at, spans = 0, []
        for i in ids:
            spans.append((at, at := at + len(spell(i))))
        if b"".join(map(spell, ids)) != b" " + text.encode():
            return None
        out.append((ids, spans))
    return out


def brute(texts):
    rows = []
    for text in texts:
        both = tokens(text) if text else None
        if both is None:
            rows.append(None)
            continue
        (a, a_spans), (b, b_spans) = both
        links = [(x, y) for x, (lo, hi) in zip(a, a_spans, strict=True) for y, (low, high) in zip(b, b_spans, strict=True) if lo < high and low < hi]
        ends = sorted({e for _, e in a_spans} & {e for _, e in b_spans})
        groups = []
        for lo, hi in zip([0, *ends], ends, strict=False):
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, spans, strict=True) if lo <= s and e <= hi) for ids, spans in ((a, a_spans), (b, b_spans))))
        rows.append((len(a), len(b), groups, links))
    counts = Counter(pair for r in rows if r for pair in set(r[3]))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [
        (r[0], r[1], len(r[2]), len(r[3]), sum(counts[p] == best[p[0]] for p in r[3]), sum(counts[p] for p in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest()) if r else (0,) * 6 + ("",)
        for r in rows
    ]


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "  two  blanks  ", "tab\there", "line\nline\n\n  x", "\n", "\t a", "it's we'll 'tis  's", "<|endoftext|> and <s> </s> <unk> <0x41>", "naïve Überraschung éé", "日本語 テキスト 🙂🙂",
    "with ▁ mark", "▁", "a▁b c", " nbsp x  y", "\x1c x\x1c y \x00 z", "é combining", "ﬁ ligature ①", "x" * 300, "supercalifragilisticexpialidocious " * 3, "​zero width", "don't  stop\r\nnow \r\n", "1234567890 12 345,678.90", "﻿bom", "a　b", "\u0085 nel   ls",
]


@pytest.mark.parametrize("broadcast", [10, 10**6])
def test_against_a_double_loop(spark, broadcast):
    r = random.Random(4)
    words = ["the", "re", "token", "alignment", "über", "naïve", "x-y", "(see", "3.14", "foo_bar", "🙂", "été", "Straße", "it's", "\t", "", " ", "\n"]
    texts = [*ODD, *(" ".join(r.choice(words) + r.choice(["", "s", ".", "ing"]) for _ in range(r.randrange(1, 40))) for _ in range(40))]
    texts += texts[-5:]
    df = spark.createDataFrame([(i % 60 if i % 7 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(3)
    got = alignment.align(df, broadcast=broadcast).collect()
    want = [(i % 60 if i % 7 else None, *w) for i, w in enumerate(brute(texts))]
    assert sorted(str(tuple(x[c] for c in ("doc_id", *COLUMNS))) for x in got) == sorted(map(str, want))


def test_groups_spelt_out(spark):
    slabs = alignment.tokenised(spark.createDataFrame([("k", "Überraschung now"), ("l", "")], "doc_id string, text string"))
    got = {x["doc_id"]: x for x in alignment.aligned(slabs, groups=True).collect()}
    assert got["l"]["groups"] == "" and got["l"]["links"] == []
    a, b = zip(*(g.split("|") for g in got["k"]["groups"].split(";")), strict=True)
    both = tokens("Überraschung now")
    assert [int(i) for g in a for i in g.split(",")] == both[0][0] and [int(i) for g in b for i in g.split(",")] == both[1][0]
    assert {x // alignment.WIDTH for x in got["k"]["links"]} == set(both[0][0])


def test_long_text_small_slabs_and_empty_table(spark, monkeypatch):
    long = "wörd" * 40_000 + " end"
    df = spark.createDataFrame([(1, long), (2, "end")], "doc_id long, text string")
    got = {x["doc_id"]: x for x in alignment.align(df).collect()}
    n = tokens(long)
    assert (got[1]["n_a"], got[1]["n_b"]) == (len(n[0][0]), len(n[1][0])) and got[1]["n_links"] == got[1]["n_a"] + got[1]["n_b"] - got[1]["n_groups"]
    assert alignment.align(df.where("doc_id > 5")).collect() == []


def test_a_worker_forgets_units_when_full():
    units = alignment._Units(alignment.BYTE_LEVEL, alignment.MODEL, room=1000)
    want = units.sides[0].encode(["again"])[0]
    for k in range(30):
        at = units.numbers([f"word{k}", "again"])[1]
        start = units.rows[0].start[at]
        assert units.rows[0].flat[start : start + units.rows[0].count[at]].tolist() == want
    assert len(units.known) < 20


def test_only_one_python_step(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = alignment.aligned(alignment.tokenised(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Pandas" not in plan

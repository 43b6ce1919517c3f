"""Every query of the subpackage on the smallest tables (with DuckDB where there is SQL), and operators against brute force on rows with clashing columns."""

import random
from bisect import bisect_left

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from formlake.llm import decontamination, line_dedup, registry, sharding, simhash_dedup, substring_dedup, toxicity
from formlake.llm import sentencepiece_codec as codec

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op4_embedding_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op6_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op8_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op11_token_alignment": {"doc_id": "bigint", **dict.fromkeys(["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"], "bigint"), "groups_sha256": "string"},
    "op12_phrase_collocations": {"lang": "string", "rank": "bigint", "phrase": "string", **dict.fromkeys(["a", "l", "r", "n", "score"], "bigint")},
    "op13_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = registry.queries()[name](spark, SF)
    if name in COLUMNS:
        assert dict(got.dtypes) == COLUMNS[name]
    rows = got.collect()
    table = {"op4_embedding_dedup": "embeddings"}.get(name, "documents")
    if name not in ("op1_line_dedup", "op3_warc_fixity", "op12_phrase_collocations"):
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name == "op9_toxicity":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    if name == "op10_simhash":
        assert all(len(r["fingerprint"]) == 16 and r["component_id"] <= r["doc_id"] for r in rows)
    if sql := registry.oracle_sql().get(name):
        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in rows)


def test_ring_against_a_walk(spark):
    """Rows in order of their places fill their own shard, the overflow walks on; the counts differ by one at most."""
    r = random.Random(3)
    keys = [r.randrange(10**9) for _ in range(211)]
    df = spark.createDataFrame([(k, i, "a", "b", "c") for i, k in enumerate(keys)], "doc_id long, spot_ long, cell string, shard string, slot string").repartition(3)
    got = sharding.place(df, "doc_id", shards=5, nodes=9, cell_bits=6)
    assert got.columns == ["doc_id", "spot_", "cell", "shard", "slot"]
    nodes = sharding.ring(5, 9)
    free = sharding.bounds(len(keys), 5)
    arcs, want, over = {}, {}, []
    for k in sorted(keys, key=lambda k: sharding.spot(str(k))):
        arcs.setdefault(bisect_left([p for p, _ in nodes], sharding.spot(str(k))) % len(nodes), []).append(k)
    for arc, (_, shard) in enumerate(nodes):
        for k in arcs.get(arc, []):
            if free[shard]:
                want[k], free[shard] = shard, free[shard] - 1
            else:
                over.append((arc, k))
    for arc, k in over:
        step = next(s for s in range(arc + 1, arc + 1 + len(nodes)) if free[nodes[s % len(nodes)][1]])
        want[k] = nodes[step % len(nodes)][1]
        free[want[k]] -= 1
    assert {x["doc_id"]: x["shard"] for x in got.collect()} == want


def test_clashing_columns_are_kept(spark):
    names = ["gone", "gone_id", "best_id", "best_tk", "hits_", "hits", "w", "tk", "cut", "n_pieces", "a.b"]
    df = spark.createDataFrame([(1, "one line here\none line here", *names), (2, "other words\nthat stay", *names)], ["doc_id", "text", *names])
    bench = spark.createDataFrame([("i", "nothing of it")], "item_id string, text string")
    for out in (line_dedup.dedup(df), simhash_dedup.dedup(df), simhash_dedup.dedup_copies(df), decontamination.decontaminate(df, bench), codec.recode(df).drop("n_pieces_", "ids_crc32")):
        assert out.columns == df.columns
        assert [tuple(x)[2:] for x in out.collect()] == [tuple(names)] * 2


def test_machine_against_its_dual_form():
    """With every example as a landmark, the decisions are those of the kernel machine solved on the full kernel matrix."""
    r = random.Random(5)
    tokens = sorted({"".join(r.choice("abcdehilnorst") for _ in range(r.randrange(4, 9))) for _ in range(40)})
    positive, negative = ({t: float(r.randrange(1, 4)) for t in part} for part in (tokens[:15], tokens[15:]))
    table, bias = toxicity.fit_tokens(positive, negative, tokens, cost=50.0)
    own = np.array([weight @ table[code] + bias for code, weight in map(toxicity.vector, tokens)])
    dense = np.zeros((len(tokens), toxicity.LETTERS**3))
    for row, (code, weight) in zip(dense, map(toxicity.vector, tokens), strict=True):
        np.add.at(row, code, weight)
    kernel = dense @ dense.T
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    c = 50.0 * np.r_[np.array([*positive.values()]) / sum(positive.values()), np.array([*negative.values()]) / sum(negative.values())]
    a, b = np.zeros(len(tokens)), 0.0
    for _ in range(20000):  # plain descent on the machine's own loss, in the coefficients of the kernel
        push = c * np.maximum(0, 1 - y * (kernel @ a + b)) * y
        a, b = a - 0.01 * (a - push), b + 0.001 * (push.sum() - 1e-6 * b)
    assert np.abs(kernel @ a + b - own).max() < 0.02


def test_index_goes_on_in_another_session(spark, tmp_path):
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[50:150])), (3, " ".join(["x", *words[20:90]]))], "doc_id long, text string")
    path = f"file://{tmp_path}/index"
    one = substring_dedup.FingerprintIndex(spark, path)
    assert one.ingest(docs.where("doc_id = 1"), docs).df.count() == 0
    two = substring_dedup.FingerprintIndex(spark, path)
    assert len(two.runs) == 1
    found = two.ingest(docs.where("doc_id > 1"), docs).df.groupBy("doc_id").agg(F.sum("count").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in found} == {2: 51, 3: 21} and len(two.runs) == 2
    two.compact()
    assert len(substring_dedup.FingerprintIndex(spark, path).runs) == 1


def test_similar_lines_meet():
    """Share of changed copies (edit similarity of 0.8 or more) that share a key with the line they come from."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randrange(2, 9)))
    met = []
    for _ in range(400):
        words = [word() for _ in range(r.randrange(4, 60))]
        copy = list(words)
        for i in r.sample(range(len(copy)), max(1, len(copy) // 15)):
            copy[i] = word()
        a, b = " ".join(words), " ".join(copy)
        if line_dedup.similar(a, b, 0.8):
            x, y = line_dedup.keys_of([a, b], line_dedup.BANDS, 0.8)
            met.append(bool(set(x.tolist()) & set(y.tolist())))
    assert len(met) > 300 and np.mean(met) > 0.9

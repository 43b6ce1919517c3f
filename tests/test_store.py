"""The document store, pages routed by kind, and extraction that goes on after a failure."""

import os
import time

import pytest

from formlake.operators import extraction
from formlake.sources.store import Store

SCHEMA = "doc_id long, lang string, text string"


def test_read_after_write(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", SCHEMA, ["doc_id"], 8)
    assert store.latest().count() == 0
    first = spark.createDataFrame([(k, "en", f"t{k}") for k in range(50)] + [(None, "en", "none")], SCHEMA)
    assert store.append(first) == 1 and store.latest().count() == 51
    assert store.append(spark.createDataFrame([(7, "de", "new"), (7, "de", "later"), (99, None, None)], SCHEMA)) == 2
    store.append(spark.createDataFrame([(8,)], "doc_id long"), gone=True)
    want = {(k, "en", f"t{k}") for k in range(50) if k not in (7, 8)} | {(None, "en", "none"), (7, "de", "new"), (99, None, None)}
    assert {tuple(r) for r in store.latest().collect()} == want
    assert store.get(doc_id=7).collect()[0]["text"] == "new" and store.get(doc_id=8).count() == 0
    assert store.get(doc_id=None).collect()[0]["text"] == "none"
    plan = store.get(doc_id=7)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    read = {f.split("/part=")[1].split("/")[0] for f in store.get(doc_id=7).inputFiles()}
    assert len(read) >= 1
    store.append(first.where("false"))
    assert store.compact() == 1 and {tuple(r) for r in store.latest().collect()} == want
    files = [f for _, _, names in os.walk(tmp_path / "s" / "gen=1") for f in names if f.endswith(".parquet")]
    assert len(files) <= 8 and store.rows().count() == len(want)
    assert store.append(spark.createDataFrame([(8, "en", "back")], SCHEMA)) == 3 and store.get(doc_id=8).count() == 1
    assert store.vacuum() == [0] and store.latest().count() == len(want) + 1


def test_unfinished_compaction_does_not_count(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", SCHEMA, ["doc_id"], 2)
    store.append(spark.createDataFrame([(1, "en", "a")], SCHEMA))
    store.compact()
    (tmp_path / "s" / "gen=1" / "_SUCCESS").unlink()
    assert store.latest().count() == 1 and store.compact() == 1 and store.rows().count() == 1
    with pytest.raises(ValueError, match="part"):
        Store(spark, "x", "doc_id long, part int", ["doc_id"])


def engines(log):
    """Readers of struct<text> pages that write down what they read; pages that say "later" fail until a file is there."""

    def make(name):
        def maker():
            def read(image):
                with open(f"{log}/{name}-{time.time_ns()}-{hash(image['text'])}", "w") as f:
                    f.write(image["text"])
                if image["text"].startswith("later") and not os.path.exists(f"{log}/now"):
                    raise ValueError("not yet")
                return f"{name}: {image['text']}", 0.5

            return read

        return maker

    return {name: make(name) for name in ("printed", "tesseract")}


def test_restart_reads_unfinished_pages_only(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = [(1, 0, ("Name: Ann Lee",), "printed", None), (1, 1, ("later City: Rome",), "mixed", "eng"), (2, 0, ("later",), "printed", "deu"), (3, 0, ("Nom",), "printed", "fra"), (3, 0, ("Zom",), "printed", "fra")]
    pages = spark.createDataFrame(rows, "doc_id long, page_idx long, image struct<text:string>, text_kind string, language string")
    read = lambda: sorted(f.read_text() for f in log.glob("*-*"))
    path = f"file://{tmp_path}/states"
    store = extraction.page_states(pages, path, engines(log), parts=4)
    assert read() == ["Name: Ann Lee", "Nom", "later", "later City: Rome"]
    state = {(r["doc_id"], r["page_idx"]): r for r in store.latest().collect()}
    assert state[1, 0]["engine"] == "printed" and state[3, 0]["engine"] == "tesseract" and state[2, 0]["error"] == "not yet" and state[2, 0]["tries"] == 1
    (log / "now").touch()
    for f in log.glob("*-*"):
        f.unlink()
    store = extraction.page_states(pages, path, engines(log), parts=4)
    assert read() == ["later", "later City: Rome"]
    state = {(r["doc_id"], r["page_idx"]): r for r in store.latest().collect()}
    assert state[2, 0]["error"] is None and state[2, 0]["tries"] == 2 and state[1, 0]["tries"] == 1
    docs = {r["doc_id"]: r for r in extraction.documents_of(store.latest()).collect()}
    assert docs[1]["n_pages"] == 2 and docs[1]["engines"] == ["printed"] and docs[1]["fields"]["name"].startswith("Ann Lee")
    assert docs[3]["engines"] == ["tesseract"] and docs[2]["errors"] == []
    for f in log.glob("*-*"):
        f.unlink()
    extraction.page_states(pages, path, engines(log), parts=4)
    assert read() == []


def test_pages_go_to_the_engine_of_their_kind(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = [(1, 0, ("a",), "printed", "eng"), (2, 0, ("b",), "handwritten", "eng"), (3, 0, ("c",), None, None), (4, 0, ("d",), "printed", "hin")]
    pages = spark.createDataFrame(rows, "doc_id long, page_idx int, image struct<text:string>, text_kind string, language string")
    own = engines(log)
    own["handwritten"] = own["printed"]
    got = {r["doc_id"]: r["engine"] for r in extraction.routed_texts(pages, own, mode="off").collect()}
    assert got == {1: "printed", 2: "handwritten", 3: "handwritten", 4: "tesseract"}
    always = {r["doc_id"]: (r["engine"], r["text"]) for r in extraction.routed_texts(pages, own, mode="always").collect()}
    assert always[4] == ("tesseract", "tesseract: d") and always[1] == ("printed", "printed: a")

"""The streaming forms give what the batch forms give."""

import json
import os

from formlake.operators.verify import verify
from formlake.streaming import fields


def test_stream_of_texts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"doc_id": i, "text": "invoice no 1 subtotal tax total amount gstin" if i % 2 else "plain", "at": f"2024-01-01T00:0{i}:00Z"} for i in range(4)]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    types = fields.stream_types(fields.texts(spark, str(tmp_path / "in")))
    q = types.writeStream.format("memory").queryName("types").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["doc_id"], r["doc_type"]) for r in spark.table("types").collect()) == [(0, "generic"), (1, "invoice"), (2, "generic"), (3, "invoice")]


def stream_of(spark, folder, name, schema, batches):
    """A stream of JSON files, one a micro-batch, in order."""
    (folder / name).mkdir()
    for i, rows in enumerate(batches):
        path = folder / name / f"{i}.json"
        path.write_text("\n".join(map(json.dumps, rows)))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder / name))


def test_verification_over_streams_is_the_batch_one(spark, tmp_path):
    day = lambda h, m=0: f"2024-01-01T{h:02d}:{m:02d}:00Z"
    asked = [
        [{"request_id": "r1", "doc_id": 1, "at": day(1), "asked": {"name": "Ann Lee", "PAN": "ABCDE1234F", "my_email": "a@b.co", "zzzz": "x"}},
         {"request_id": "r2", "doc_id": 2, "at": day(1), "asked": {"name": "Bob"}}],  # its extraction comes first
        [{"request_id": "r3", "doc_id": 1, "at": day(1, 30), "asked": {"name": "Lee Ann"}}, {"request_id": "r4", "doc_id": 9, "at": day(1), "asked": {"name": "Nobody"}}],
        [{"request_id": "late", "doc_id": 2, "at": day(20), "asked": {"name": "Bob"}}],  # moves the watermark on
        [{"request_id": "end", "doc_id": 77, "at": day(23), "asked": {"name": "x"}}],
    ]
    found = [
        [{"doc_id": 2, "found_at": day(0, 30), "have": {"name": "Bob"}}],
        [{"doc_id": 1, "found_at": day(1, 50), "have": {"name": "Ann Lee", "pan": "ABCDE1234F", "email": "a@b.co"}}],
        [{"doc_id": 5, "found_at": day(20), "have": {"name": "Eve"}}],
        [{"doc_id": 6, "found_at": day(23), "have": {"name": "Eve"}}],
    ]
    s = stream_of(spark, tmp_path, "asked", "request_id string, doc_id long, at timestamp, asked map<string,string>", asked)
    e = stream_of(spark, tmp_path, "found", "doc_id long, found_at timestamp, have map<string,string>", found)
    out = str(tmp_path / "out")
    q = fields.verify_stream(s, e, out, str(tmp_path / "cp"))
    assert q.awaitTermination(150) and q.exception() is None
    got = {(r["request_id"], r["field"]): (r["submitted"], r["extracted"], round(r["similarity"], 6), r["status"]) for r in spark.read.parquet(out).collect()}
    # the same by the batch operator, request by request, against the extraction within its hour
    pairs = [(r, f) for r in sum(asked[:2], []) for f in [next((f for f in sum(found, []) if f["doc_id"] == r["doc_id"]), None)]]
    sub = spark.createDataFrame([(r["request_id"], k, v) for r, _ in pairs for k, v in r["asked"].items()], "doc_id string, field string, submitted string")
    have = spark.createDataFrame([(r["request_id"], k, v) for r, f in pairs if f for k, v in f["have"].items()], "doc_id string, field string, value string")
    want = {(r["doc_id"], r["field"]): (r["submitted"], r["extracted"], round(r["similarity"], 6), r["status"]) for r in verify(sub, have).collect()}
    assert {k: v for k, v in got.items() if k[0] not in ("late", "end")} == want
    assert got["r1", "my_email"][3] == "match" and got["r4", "name"][1:] == (None, 0.0, "not_found")

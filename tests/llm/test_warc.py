import base64
import gzip
import hashlib
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kerege.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, archive int, `Length` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(4)


LONG = "<p>é字</p>\r\n\r\nWARC/1.1\r\n" * 40_000
ROWS = [(1, "http://a/1", "<p>a</p>"), (2, "http://a/2", "<p>b</p>"), (3, "http://a/3", "<p>a</p>"), (9, "http://a/9", "<p>a</p>"), (4, None, None), (5, "http://x y/ü\r\nZ: 1", ""), (6, "http://l", LONG), (7, "http://l2", LONG)]
ROWS += [(None, "http://n", "<p>b</p>"), (None, "http://n", "only here"), (None, "http://n2", "only here"), (11, "u", "same"), (11, "u", "same"), (11, "u", "other")]


def expected(rows, least=0):
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        last = max(same, default=None) if len(payload) >= least else None
        other = last if last is not None and page_id != last else None
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if other is None else "revisit", other))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5, 10**9])
def test_round_trip_equals_brute_force(spark, least):
    got = warc.round_trip(frame(spark, ROWS), least)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(ROWS, least)


def test_many_repeated_payloads_meet_by_shuffle(spark):
    rows = ROWS + [(100 + k, "u", f"page {k % 7}") for k in range(60)]
    plan = warc.planned(frame(spark, rows), broadcast_bytes=0)
    got = plan.select("page_id", F.length("payload"), "payload_digest", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"), "refers_to")
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)
    urls = {r.refers_to: r.refers_url for r in plan.where("refers_to is not null").collect()}
    assert urls[9] == "http://a/9"


def test_empty_table(spark):
    assert warc.round_trip(frame(spark, [])).collect() == []


def plain_records(path):
    """Records of an archive, read from its start to its end without index or offsets."""
    raw = gzip.open(path).read()
    while raw:
        head, _, raw = raw.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        block, end, raw = raw[:size], raw[size : size + 4], raw[size + 4 :]
        assert head.startswith(b"WARC/1.1\r\n") and end == b"\r\n\r\n"
        yield dict(x.decode().split(": ", 1) for x in head.split(b"\r\n")[1:]), block


def test_archives_are_whole_and_indexed(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    index = warc.archived(frame(spark, ROWS), folder, size=500)
    paths = sorted(tmp_path.glob("w/*.warc.gz"))
    records = [x for p in paths for x in plain_records(p)]
    assert len(records) == len(ROWS) and len(paths) > 4  # small archives: several a task
    by_id = {h["WARC-Record-ID"]: h for h, _ in records if h["WARC-Type"] == "response"}
    for head, block in records:
        payload = block.partition(b"\r\n\r\n")[2]
        if head["WARC-Type"] == "revisit":
            assert payload == b"" and head["WARC-Profile"] == warc.SAME_PAYLOAD
            first = by_id[head["WARC-Refers-To"]]
            assert first["WARC-Payload-Digest"] == head["WARC-Payload-Digest"] and first["WARC-Target-URI"] == head["WARC-Refers-To-Target-URI"] and first["Page-Id"] == head["Refers-To-Page-Id"]
        else:
            assert "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() == head["WARC-Payload-Digest"]
    names = ["page_id", "record_type", "payload_digest", "offset", "length"]
    where = lambda df: sorted((tuple(r) for r in df.select(*names, F.element_at(F.split("archive", "/"), -1)).collect()), key=str)
    assert where(warc.indexed(spark, folder)) == where(index)


def test_selected_records_are_read(spark, tmp_path):
    rows = [(k, f"http://h/{k % 3}", f"<p>{k}</p>" * 50) for k in range(200)]
    index = warc.archived(frame(spark, rows), f"file://{tmp_path}/w")
    some = index.where("url = 'http://h/1' and page_id < 100")
    for gap, most in ((0, 1), (0, 1 << 20), (10**6, 1 << 20), (10**6, 300)):
        got = {r.page_id: (r.url, bytes(r.payload).decode()) for r in warc.fetched(some, gap, most, share=1000).collect()}
        assert got == {k: (u, h) for k, u, h in rows if u == "http://h/1" and k < 100}


def test_ranges():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 20, 5), ("a", 100, 7), ("b", 107, 5), ("b", 112, 90)]
    assert [len(x) for x in warc._ranges(iter(rows), 5, 1000)] == [3, 1, 2]
    assert [len(x) for x in warc._ranges(iter(rows), 0, 1000)] == [2, 1, 1, 2]
    assert [len(x) for x in warc._ranges(iter(rows), 1000, 20)] == [2, 1, 1, 1, 1]


def test_damage_is_seen(spark, tmp_path):
    index = warc.archived(frame(spark, ROWS[:2]), f"file://{tmp_path}/w")
    with pytest.raises(Exception, match="WARC record|gzip|digest|Not a gzipped|decompress"):
        warc.fetched(index.withColumn("offset", F.col("offset") + 1)).collect()
    good = warc.record(1, "u", b"payload", warc.digest(b"payload"), None, None, "2020-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="digest"):
        warc._unpacked(gzip.compress(gzip.decompress(good).replace(b"payload\r\n\r\n", b"Payload\r\n\r\n")), 1, "u")
    two = good + good[: len(good) // 2]
    assert [(o, n) for o, n, _ in warc.members(iter([two[:7], two[7:50], two[50:]]))] == [(0, len(good))]
    assert isinstance(warc._batch([], warc.RECORD), pa.RecordBatch)


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{sf}/pages.parquet')")
    found, wanted = warc.op12_warc_index(spark, sf), con.execute(warc.OP12_SQL).to_arrow_table()
    assert found.columns == wanted.column_names
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(zip(*(c.to_pylist() for c in wanted.columns), strict=True), key=str)

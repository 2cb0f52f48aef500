import base64
import hashlib
import os
import zlib

import pytest

from paperloom.llm import warc


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


ROWS = [
    (5, "http://a/1", "<p>same é</p>"), (2, "http://a/2", "<p>same é</p>"), (9, "http://a/3", "<p>same é</p>"), (1, None, None), (3, "u r\nl", ""), (4, "x", "own"), (4, "x", "own"), (4, "x", "other"),
    (None, "n", "own"), (7, "b", "y" * 200_000), (8, "b", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"),
]
WANT = {5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 2), 1: ("response", None), 3: ("revisit", 1), 7: ("response", None), 8: ("response", None)}


def write(spark, folder, **more):
    df = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").repartition(5)
    return warc.write_archives(df, folder, **more)


def test_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    manifest = write(spark, folder, roll_bytes=700, shards=3)
    rows = warc.read_archives(manifest, folder).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r["payload"] is None if r["record_type"] == "revisit" else (digest(r["payload"].decode()) == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"])
        if r["page_id"] in WANT:
            html = next(h for k, _, h in ROWS if k == r["page_id"])
            assert ((r["record_type"], r["refers_to"]), r["payload_digest"], r["payload_bytes"]) == (WANT[r["page_id"]], digest(html), len((html or "").encode()))
    four = sorted((r["payload_digest"] == digest("own"), r["record_type"], r["refers_to"]) for r in rows if r["page_id"] == 4)
    assert four == [(False, "response", None), (True, "response", None), (True, "revisit", 4)]
    assert [r["record_type"] for r in rows if r["page_id"] is None] == ["response"]
    files = sorted(os.listdir(tmp_path / "w"))
    assert sum(f.endswith(".gz") for f in files) == manifest.count() > 3 and "_temporary" not in files and "_listed" not in files


def test_files_are_ranges_and_the_same_each_time(spark, tmp_path):
    content = []
    for k in range(2):
        folder = f"file://{tmp_path}/{k}"
        listed = sorted((r["path"].rsplit("/", 1)[1], r["records"], r["bytes"]) for r in write(spark, folder, roll_bytes=700, shards=2).collect())
        content.append((listed, [(tmp_path / str(k) / n).read_bytes() for n, _, _ in listed]))
    assert content[0] == content[1]
    pages = [[warc.parsed(m)[0] for m in warc.members(open(tmp_path / "0" / n, "rb"))] for n, _, _ in content[0][0]]
    ids = [int(f["X-Page-Id"]) for fs in pages for f in fs if f.get("X-Page-Id")]
    assert ids == sorted(ids) and all(fs[0]["WARC-Type"] == "warcinfo" for fs in pages)


def test_commit_survives_a_second_attempt(tmp_path):
    import pyarrow as pa

    (tmp_path / "t").write_bytes(b"x")
    batch = pa.RecordBatch.from_pydict({"temporary": [f"{tmp_path}/t"], "path": [f"{tmp_path}/f"], "records": [1]})
    commit = warc._committing(f"file://{tmp_path}")
    assert [b.column_names for b in commit(iter([batch]))] == [b.column_names for b in commit(iter([batch]))] == [["path", "records"]]
    with pytest.raises(OSError):
        list(commit(iter([pa.RecordBatch.from_pydict({"temporary": [f"{tmp_path}/no"], "path": [f"{tmp_path}/no2"]})])))


def test_broken_archives_are_noticed():
    record = warc.page_record(1, "u", b"payload", None)
    assert warc.parsed(record)[1].endswith(b"payload")
    with pytest.raises(ValueError, match="broken"):
        warc.parsed(record.replace(b"payload", b"PAYLOAD"))
    import io

    whole = warc._member(record) * 2
    assert [warc.parsed(m)[0]["X-Page-Id"] for m in warc.members(io.BytesIO(whole))] == ["1", "1"] and zlib.decompress(whole, 31) == record
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(io.BytesIO(whole[:-60])))


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/e"
    manifest = warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string, first int, digest int"), folder)
    assert manifest.count() == 0 and warc.read_archives(manifest, folder).count() == 0

"""WARC: exact round trips, revisits, and blocks that look like records."""

import glob
import gzip
import hashlib
import io
import zlib
from collections import Counter

import pytest

from hopwise.llm import warc
from hopwise.llm.common import scratch_path

PAGES = "page_id long, url string, html string"


def expected(rows):
    payload = [(p, (h or "").encode()) for p, _, h in rows]
    out = []
    for p, b in payload:
        same = [q for q, c in payload if c == b]
        first = max((q for q in same if q is not None), default=None)
        again = len(b) >= 1000 and len(same) > 1 and first is not None and p != first
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return Counter(out)


def test_round_trip(spark):
    tricky = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n" * 20
    big = "<p>é\n</p>" * 400
    rows = [(1, "http://a", big), (2, "http://b", big), (5, None, big), (None, "u", big), (3, "u\r\nWARC-Type: x", tricky), (4, "u", None), (6, "u", "small"), (7, "u", "small"), (7, "u", "small"), (8, "u", "\n\n"), (9, "u", "z" * 300_000), (10, "v", big + "x"), (10, "v", big + "x")]
    found = warc.round_trip(spark.createDataFrame(rows, PAGES))
    assert Counter(tuple(r) for r in found.collect()) == expected(rows)


def test_captures_are_nested(spark):
    path = scratch_path(spark, "warc-test")
    warc.write(spark.createDataFrame([(1, "http://a/b", "<p>hi</p>")], PAGES), path)
    (row,) = warc.captures(warc.records(spark, path)).collect()
    assert row["uri"] == "http://a/b" and row["response"]["payload"] == b"<p>hi</p>"
    assert row["request"]["http"].startswith("GET http://a/b HTTP/1.1") and row["metadata"]["page_id"] == 1


def test_empty_table_and_clashing_columns(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    data = spark.createDataFrame([(1, "u", "h", "x", "y")], PAGES + ", payload_bytes string, first string")
    assert warc.round_trip(data).first()["payload_bytes"] == 1


def test_a_cut_archive_is_an_error():
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse("f", io.BytesIO(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nabc"), True))


def members(data):
    """The gzip members of a file, each on its own."""
    out = []
    while data:
        one = zlib.decompressobj(31)
        out.append(one.decompress(data) + one.flush())
        assert one.eof
        data = one.unused_data
    return out


def test_archives_have_a_member_for_each_record_and_are_cut_by_bytes(spark):
    path = scratch_path(spark, "warc-test")
    rows = [(k, f"http://a/{k}", hashlib.sha512(str(k).encode()).hexdigest() * 20) for k in range(60)]
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), path, file_bytes=20_000)
    files = glob.glob(f"{path.removeprefix('file:')}/*/*.warc.gz")
    assert len(files) > 2 and not glob.glob(f"{path.removeprefix('file:')}/**/*.txt", recursive=True)
    kinds = Counter()
    for file in files:
        data = open(file, "rb").read()
        assert len(data) < 20_000 + 5000
        found = members(data)
        assert found[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        for one in found:
            (row,) = warc.parse("f", io.BytesIO(one), True)
            kinds[row["type"]] += 1
        assert gzip.decompress(data) == b"".join(found)
    assert kinds == {"warcinfo": len(files), "request": 60, "response": 60, "metadata": 60}


def test_a_record_beyond_sixteen_megabytes(spark):
    rows = [(1, "u", "x" * (17 << 20)), (2, "u", "y"), (3, "u", None)]
    found = warc.round_trip(spark.createDataFrame(rows, PAGES).coalesce(1))
    assert Counter(tuple(r) for r in found.collect()) == expected(rows)


def test_large_archives_are_streamed(spark):
    path = scratch_path(spark, "warc-test")
    warc.write(spark.createDataFrame([(k, "u", f"page {k}") for k in range(30)], PAGES), path)
    one, two = (warc.records(spark, path, whole_bytes=n).drop("file") for n in (warc.WHOLE_BYTES, 0))
    key = lambda r: str(r.asDict())
    assert sorted(one.collect(), key=key) == sorted(two.collect(), key=key) and one.count() > 90


def test_records_without_their_others(spark):
    made = [("request", "<a>", "<r>"), ("metadata", "<b>", "<s>"), ("response", "<t>", None), ("response", "<u>", None), ("request", "<c>", "<u>"), ("warcinfo", "<i>", None)]
    rows = [dict.fromkeys(warc.RECORD.names) | {"file": "f", "number": k, "type": t, "record_id": i, "concurrent_to": c, "uri": f"http://{k}"} for k, (t, i, c) in enumerate(made)]
    found = warc.captures(spark.createDataFrame(rows, warc.RECORD_DDL)).collect()
    told = {(r["capture"], r["uri"], bool(r["request"]), bool(r["response"]), bool(r["metadata"])) for r in found}
    assert told == {("<r>", "http://0", True, False, False), ("<s>", "http://1", False, False, True), ("<t>", "http://2", False, True, False), ("<u>", "http://3", True, True, False)}

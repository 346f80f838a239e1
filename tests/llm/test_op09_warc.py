import io

from promptspread.llm import warc
from promptspread.llm.common import fresh_path
from tests.llm.helpers import against_oracle

SCHEMA = "page_id long, url string, html string, payload string"


def test_oracle(spark):
    against_oracle(spark, "op9_warc")


def test_round_trip_of_odd_pages(spark):
    long = "é😀" * 50_000
    rows = [(1, "u", long), (2, "u\nx", long), (3, None, None), (4, "z", ""), (5, "q", "WARC/1.1\r\n\r\n\r\n0\r\n\r\n"), (5, "q", "WARC/1.1\r\n\r\n\r\n0\r\n\r\n"),
            (None, "n", long), (None, "n", "solo"), (6, "a", "中" * 30_001)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    path = fresh_path(spark, "warc")
    warc.write(df, path, segment_bytes=10_001)
    back = warc.read(spark, path).collect()
    assert len(back) == len(rows) and all(r.complete for r in back)
    got = sorted((r.record_id.split(":")[2], r.record_type, r.refers_to and r.refers_to.split(":")[2], r.payload_bytes, r.payload_digest) for r in back)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        last = max((k for k, _, h in rows if (h or "") == (html or "") and k is not None), default=None)
        other = last is not None and i != last
        want.append((str(i), "revisit" if other else "response", str(last) if other else None, len(raw), warc.digest(raw)))
    assert got == sorted(want)
    payloads = {(r.record_id.split(":")[2], bytes(r.payload)) for r in back if r.record_type == "response"}
    assert ("2", long.encode()) in payloads and ("6", ("中" * 30_001).encode()) in payloads
    assert {r.url for r in back} == {"u", "u%0Ax", None, "z", "q", "n", "a"}
    small = fresh_path(spark, "warc")
    warc.write(df, small, least_bytes=10 ** 9)
    assert {r.record_type for r in warc.read(spark, small).collect()} == {"response"}
    none = fresh_path(spark, "warc")
    warc.write(df.limit(0), none)
    assert warc.read(spark, none).count() == 0


def test_damaged_segments_are_incomplete():
    raw = b"x" * 5000
    parts = [warc._row(next(warc.parse(io.BytesIO(r + b"\r\n\r\n")))) for r in warc.row_records("id", "u", raw, None, warc.digest(raw), 1000)]
    assert len(parts) > 4
    whole = list(warc.reassembled(iter(parts)))
    assert len(whole) == 1 and whole[0]["payload"] == raw and whole[0]["payload_digest"] == warc.digest(raw)
    for broken in (parts[:2] + parts[3:], parts[:-1], parts[:2] + [parts[1]] + parts[2:], [*parts[:-1], parts[-1] | {"total": 7}]):
        assert [(r["complete"], r["payload"]) for r in warc.reassembled(iter(broken))] == [(False, None)]


def test_chunked_framing():
    for body in (b"", b"a", b"\r\n0\r\n\r\n" * 3000):
        assert warc.unchunked(warc.chunked(body, 100)) == body
    assert warc.unchunked(b"5\r\nabc") is None and warc.unchunked(b"zz\r\n") is None and warc.unchunked(b"1\r\na\r\n") is None

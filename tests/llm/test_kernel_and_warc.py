"""Kernels against plain Python, and WARC reading on whole and damaged streams."""

import gzip
import hashlib
import io
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import kernel as K
from textloom.llm import warc


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é日\n\t ", max_size=30)), max_size=8))
@settings(max_examples=80, deadline=None)
def test_words_are_those_of_split(texts):
    data, offsets, valid = K.buffers(pa.array(texts, pa.string()))
    assert valid.tolist() == [t is not None for t in texts]
    hashes = {}
    for size in (1, 1 << 20):
        for a, b, d, o in K.blocks(data, offsets, size):
            w = K.Words(d, o, K.SPACE)
            for i in range(b - a):
                want = [x for x in re.split(r"[\t-\r\x1c- ]+", texts[a + i] or "") if x]
                at = range(w.first[i], w.first[i + 1])
                assert [d[w.start[j] : w.end[j]].tobytes().decode() for j in at] == want
                for j, x in zip(at, want):
                    assert hashes.setdefault(x, int(w.hash[j])) == int(w.hash[j])
    assert len(set(hashes.values())) == len(hashes)


@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.integers(1, 9))
@settings(max_examples=80, deadline=None)
def test_windows_and_minima(values, k):
    x = np.array(values, np.uint64)
    w = K.windows(x, k)
    runs = [tuple(values[i : i + k]) for i in range(len(values) - k + 1)]
    assert len(w) == len(runs)
    assert len({(r, int(h)) for r, h in zip(runs, w)}) == len(set(runs)) == len({int(h) for h in w})
    if len(values) >= k:
        assert K.sliding_min(x, k).tolist() == [min(r) for r in runs]


def test_sliced_arrays_keep_their_place():
    a = pa.array(["one", None, "two", "three"]).slice(1, 2)
    data, offsets, valid = K.buffers(a)
    assert data.tobytes() == b"two" and offsets.tolist() == [0, 0, 3] and valid.tolist() == [False, True]


class Drip(io.BytesIO):
    """Gives a few bytes at a time, as a slow stream does."""

    def read(self, n=-1):
        return super().read(random.Random(self.tell()).randrange(1, 9))


def record(body, uri="http://a", digest=None):
    return warc.member([("WARC-Type", "response"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest or warc.digest_of(body))], body)


def test_reader_frames_members():
    bodies = [b"", b"x", b"\r\n\r\nWARC/1.1\r\n", bytes(range(256)) * 300]
    rows = list(warc.Reader(Drip(b"".join(map(record, bodies)))))
    assert [r["payload"] for r in rows] == bodies and {r["status"] for r in rows} == {"ok"}
    assert [r["member"] for r in rows] == [0, 1, 2, 3]
    assert list(warc.Reader(io.BytesIO(b""))) == []
    two = gzip.compress(gzip.decompress(record(b"1")) + gzip.decompress(record(b"2")))
    assert [r["payload"] for r in warc.Reader(io.BytesIO(two))] == [b"1", b"2"]


def test_reader_reports_damage():
    good = record(b"good")
    status = lambda b: [r["status"] for r in warc.Reader(io.BytesIO(b))]
    assert status(record(b"x", digest="sha1:AAAA") + good) == ["digest_mismatch", "ok"]
    assert status(gzip.compress(b"nonsense\r\n\r\n") + good) == ["bad_header", "ok"]
    assert status(gzip.compress(b"WARC/1.1\r\nWARC-Type: x\r\n\r\nabc") + good) == ["bad_header", "ok"]
    assert status(good + good[:-20]) == ["ok", "truncated"]
    assert status(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc") + good) == ["truncated", "ok"]
    assert status(b"garbage" + good) == ["bad_gzip", "ok"]
    broken = bytearray(record(bytes(random.Random(1).randbytes(4000))))
    broken[2000:2010] = b"\xff" * 10
    assert status(bytes(broken) + good)[-1] == "ok"
    assert status(warc.member([("WARC-Type", "metadata")], b"q")) == ["no_digest"]
    assert warc.verify("SHA-256:" + hashlib.sha256(b"a").hexdigest(), b"a") and warc.verify("nope:1", b"a") is None
    assert warc.verify("sha3-256:" + hashlib.sha3_256(b"a").hexdigest(), b"a") and warc.verify("shake_128:x", b"a") is None


def http(kind, block, **more):
    return warc.member([("WARC-Type", kind), ("Content-Type", f"application/http; msgtype={kind}"), *((k.replace("_", "-"), v) for k, v in more.items())], block)


def test_payload_digests_of_each_kind_of_record():
    head, body = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n", b"<p>\r\n\r\nx</p>"
    whole, part = warc.digest_of(head + body), warc.digest_of(body)
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    pieces = b"4;a=b\r\n<p>\r\r\na\r\n\n\r\nx</p>12\r\n0\r\n\r\n"
    members = [
        http("response", head + body, WARC_Block_Digest=whole, WARC_Payload_Digest=part),
        http("response", head + body, WARC_Block_Digest=part),
        http("response", head + body, WARC_Payload_Digest=whole),
        http("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Payload_Digest=warc.digest_of(b"")),
        http("revisit", head, WARC_Payload_Digest=part, WARC_Block_Digest=warc.digest_of(head)),
        http("revisit", head, WARC_Payload_Digest=part),
        http("response", head + body, WARC_Payload_Digest="sha1:AAAA", WARC_Segment_Number="1"),
        warc.member([("WARC-Type", "warcinfo"), ("Content-Type", "application/warc-fields"), ("WARC-Payload-Digest", warc.digest_of(b"a: b\r\n\r\n"))], b"a: b\r\n\r\n"),
        http("response", head + body, WARC_Block_Digest="shake_128:x"),
        http("response", head + body, WARC_Block_Digest="shake_128:x", WARC_Payload_Digest=part),
        http("response", chunked + pieces, WARC_Payload_Digest=warc.digest_of(pieces)),
        http("response", chunked + pieces, WARC_Payload_Digest=warc.digest_of(b"<p>\ra\r\n\nx</p>12"[:4] + warc.unchunked(pieces)[4:])),
        http("response", chunked + pieces, WARC_Payload_Digest=warc.digest_of(b"other")),
    ]
    rows = list(warc.Reader(io.BytesIO(b"".join(members))))
    assert [r["status"] for r in rows] == ["ok", "digest_mismatch", "digest_mismatch", "ok", "ok", "no_digest", "no_digest", "ok", "unknown_digest", "ok", "ok", "ok", "digest_mismatch"]
    assert rows[0]["http_header"] == head and rows[0]["payload"] == body and rows[0]["content_length"] == len(head + body) and rows[7]["http_header"] is None
    assert warc.unchunked(b"3\r\nabc\r\n0\r\n\r\n") == b"abc" and warc.unchunked(b"3\r\nab") is None and warc.unchunked(b"zz\r\n") is None


def test_bounds_have_one_outcome():
    def long(n):
        return gzip.compress(b"WARC/1.1\r\nX: " + b"a" * n + b"\r\nContent-Length: 1\r\n\r\nq\r\n\r\n")

    exact = 5000 - len(b"WARC/1.1\r\nX: \r\nContent-Length: 1\r\n\r\n")
    good = record(b"good")
    for stream in (io.BytesIO, Drip):
        read = lambda b, **more: [r["status"] for r in warc.Reader(stream(b), **more)]
        assert read(long(exact) + good, max_header=5000) == ["no_digest", "ok"] and read(long(exact + 1) + good, max_header=5000) == ["bad_header", "ok"]
        assert read(record(b"x" * 5000) + good, max_block=4999) == ["too_long", "ok"] and read(record(b"x" * 5000) + good, max_block=5000) == ["ok", "ok"]
    assert [r["status"] for r in warc.Reader(io.BytesIO(gzip.compress(b"WARC/1.1\r\n" + b"a" * 40_000_000) + good))] == ["bad_header", "ok"]
    for bad in ("\u00b2", "9" * 5000, "9" * 20, "-1", "1_0", "", " 1 2"):
        raw = gzip.compress(f"WARC/1.1\r\nContent-Length: {bad}\r\n\r\nq\r\n\r\n".encode())
        assert [r["status"] for r in warc.Reader(io.BytesIO(raw + good))] == ["bad_header", "ok"], bad
    rows = list(warc.Reader(io.BytesIO(gzip.compress(b"WARC/1.1\r\nContent-Length: 999999999999999999\r\n\r\nq") + good)))
    assert [r["status"] for r in rows] == ["too_long", "ok"][1:] or [r["status"] for r in rows] == ["truncated", "ok"]
    assert sum(b.num_rows for b in warc._batches(iter(rows))) == 2


@given(st.lists(st.tuples(st.sampled_from(["Content-Length", "WARC-Type", "Content-Type", "WARC-Block-Digest", "WARC-Payload-Digest", "X"]), st.one_of(st.text(max_size=12), st.sampled_from(["3", "application/http", "sha1:", "md5:x", "blake2b:zz", "response"]))), max_size=6), st.binary(max_size=40), st.integers(0, 400))
@settings(max_examples=150, deadline=None)
def test_no_header_raises(headers, body, cut):
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    data = gzip.compress(raw.encode("utf-8", "surrogatepass") + body) + record(b"good")
    for stream in (data, data[:cut], data[cut:]):
        rows = list(warc.Reader(io.BytesIO(stream)))
        assert sum(b.num_rows for b in warc._batches(iter(rows))) == len(rows)
    assert list(warc.Reader(io.BytesIO(data)))[-1]["payload"] == b"good"


def test_pages_round_trip(spark):
    rows = [(1, "http://a/é?x=1", "<p>é</p>\r\n\r\n", 7), (2, None, "", 7), (3, "http://b", None, 7), (None, "u", "z" * 300_000, 7), (1, "http://a/é?x=1", "<p>é</p>\r\n\r\n", 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, status int")
    got = warc.pages_round_trip(spark, df).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.page_id, r.url, r.html) for r in got), key=key) == sorted((r[:3] for r in rows), key=key)
    assert {r.status for r in got} == {"ok"}
    empty = warc.pages_round_trip(spark, df.limit(0))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "html", "content_length", "status"]

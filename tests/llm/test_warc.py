import base64
import gzip
import hashlib
import io
import random

import pytest
from compare import assert_same

from tracksmith.llm import warc
from tracksmith.llm.common import fresh_path

PAGES = [(i, f"http://h{i % 3}.example/{i}", f"<p>{'x' * (i * 37 % 400)} {i % 7}</p>") for i in range(60)]
PAGES += [(100, None, None), (101, "http://a/", ""), (102, "http://a/\r\nX: 1", "é" * 5000), (-5, "http://b/", "<p>shared</p>"), (103, "http://b/", "<p>shared</p>"), (103, "http://b/", "<p>shared</p>"), (None, "http://c/", "<p>shared</p>"), (None, "http://c/", "alone")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("split", [1, 97, 1000, 1 << 25])
def test_round_trip_at_any_split(spark, split):
    archives = warc.write_archives(frame(spark, PAGES).repartition(3), fresh_path(spark, "warc"))
    size = archives.agg({"bytes": "max"}).first()[0]
    got = warc.read_archives(archives, max(split, size // 200), with_payload=True).collect()
    owner = {}
    for i, _, html in PAGES:
        if i is not None:
            owner[html or ""] = min(i, owner.get(html or "", i))
    count = {}
    for _, _, html in PAGES:
        count[html or ""] = count.get(html or "", 0) + 1
    want = []
    for i, url, html in PAGES:
        raw = (html or "").encode()
        first = owner.get(html or "") if count[html or ""] > 1 else i
        revisit = first is not None and i != first
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None, None if revisit else raw))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)


def test_archives_are_plain_gzip(spark):
    archives = warc.write_archives(frame(spark, PAGES[:5]).coalesce(1), fresh_path(spark, "warc"))
    path = archives.first().path.removeprefix("file:")
    text = gzip.open(path).read()
    assert text.startswith(b"WARC/1.1\r\n") and text.count(b"WARC-Type: ") == 5


def test_an_archive_inside_a_record_is_not_read(spark):
    inner = b"".join(warc.make_record(i, "http://i/", b"inner", None, False, "2024-01-01T00:00:00Z") for i in range(4))
    head = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % (3000 + len(inner))
    outer = gzip.compress(head + bytes(3000) + inner + b"\r\n\r\n", 0)
    data = outer + warc.make_record(9, "http://o/", b"after", None, False, "2024-01-01T00:00:00Z")
    for step in (2000, 2500, 2900, 10_000):
        found = [r for begin in range(0, len(data), step) for r in warc.records_between(io.BytesIO(data), begin, min(begin + step, len(data)), len(data))]
        assert [warc.parse_header(r)[0]["warc-type"] for r in found] == ["resource", "response"]


def test_cut_off_archive_is_an_error():
    data = warc.make_record(1, "http://o/", b"x" * 100, None, False, "2024-01-01T00:00:00Z")[:-20]
    with pytest.raises(ValueError, match="cut off|no record"):
        list(warc.records_between(io.BytesIO(data), 0, len(data), len(data)))


def test_smaller_payloads_are_not_revisited(spark):
    archives = warc.write_archives(frame(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), fresh_path(spark, "warc"), revisit_bytes=3)
    assert {r.page_id: r.record_type for r in warc.read_archives(archives).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_no_pages(spark):
    assert warc.read_archives(warc.write_archives(frame(spark, []), fresh_path(spark, "warc"))).count() == 0


def test_query_equals_sql(spark, sf_dir):
    assert_same(warc.op3_warc(spark, sf_dir), warc.OP3_SQL, sf_dir)


@pytest.mark.parametrize("split", [5_000, 40_000, 1 << 25])
def test_urls_longer_than_64_kb(spark, split):
    long = "http://h/" + "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(6_000))
    pages = [(i, long[: 9 + 60_000 * i] if i % 2 else f"http://h/{i}", f"<p>{i}</p>") for i in range(7)]
    archives = warc.write_archives(frame(spark, pages).coalesce(1), fresh_path(spark, "warc"))
    got = warc.read_archives(archives, split, with_payload=True).collect()
    assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in got) == pages


class Counted(io.BytesIO):
    got = 0

    def read(self, n=-1):
        raw = super().read(n)
        self.got += len(raw)
        return raw


def test_a_range_is_read_once():
    rng = random.Random(3)
    data = b"".join(warc.make_record(i, f"http://h/{i}", rng.randbytes(1_800), None, False, "2024-01-01T00:00:00Z") for i in range(3_000))
    half = len(data) // 2
    found = []
    for begin, end in ((0, half), (half, len(data))):
        file = Counted(data)
        found += list(warc.records_between(file, begin, end, len(data)))
        assert file.got < 1.2 * (end - begin)
    assert [warc.page_of(warc.parse_header(r)[0]["warc-record-id"]) for r in found] == list(range(3_000))


def test_archives_stay_small(spark):
    pages = [(i, "http://h/", hashlib.sha256(str(i).encode()).hexdigest() * 20) for i in range(50)]
    archives = warc.write_archives(frame(spark, pages).coalesce(1), fresh_path(spark, "warc"), archive_bytes=3_000)
    sizes = [r.bytes for r in archives.collect()]
    assert len(sizes) > 5 and max(sizes) < 4_000
    assert sorted(r.page_id for r in warc.read_archives(archives, 700).collect()) == list(range(50))

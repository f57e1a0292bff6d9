"""Archives: round trips, format, damage."""

import gzip
import hashlib
import zlib

import pytest

from pharmasift.llm import common, warc

LONG = "<p>é" + "x" * 200


def expected(rows):
    digest = [hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in rows]
    out = []
    for (page, _, html), d in zip(rows, digest):
        n = len((html or "").encode())
        first = min((p for (p, _, _), e in zip(rows, digest) if e == d and p is not None), default=None)
        again = n >= 100 and first is not None and page != first
        out.append((page, n, d, "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/ü?x=1 2", LONG), (2, "http://b", LONG), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "bad\r\nX: y", "z" * 99),
    (8, "u", "z" * 99), (9, "u", "z" * 100), (10, "u", "z" * 100), (None, "u", LONG), (11, "u", "\r\n\r\nWARC/1.1\r\n" * 20_000), (12, "u", "é" * 700_000),
    (2, "http://b", LONG), (1, "again", LONG),
]


def test_pages_come_back(spark, as_list):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS payload", "3 AS first")
    found = warc.round_trip(pages).cache()
    assert as_list(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == expected(ROWS)
    assert found.where("NOT verified").isEmpty()
    plain = [(r.page_id or 0, r.url or "") for r in found.collect()]
    assert sorted(plain) == sorted((p or 0, warc.header_uri(u or "")) for p, u, _ in ROWS)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_every_record_is_a_member_of_its_own(spark):
    folder = common.fresh_path(spark, "warc")
    pages = spark.createDataFrame(ROWS[:4], "page_id long, url string, html string").coalesce(1)
    archives = warc.write(warc.planned(pages), folder).collect()
    assert sum(a.records for a in archives) == 4
    for a in archives:
        data = open(a.path.removeprefix("file:").replace("//", "/"), "rb").read()
        n = 0
        while data:
            unpack = zlib.decompressobj(31)
            record = unpack.decompress(data)
            assert record.startswith(b"WARC/1.1\r\nWARC-Type: ") and record.endswith(b"\r\n\r\n")
            data, n = unpack.unused_data, n + 1
        assert n == a.records


def chunks(data, size):
    return (data[i : i + size] for i in range(0, len(data), size))


@pytest.mark.parametrize("size", [1, 7, 10**6])
def test_reader_takes_any_chunks(size):
    payload = b"a\r\n" * 2000
    digest = hashlib.sha256(payload).hexdigest()
    data = b"".join(gzip.compress(warc.record_bytes(i, "u", payload, digest, r)) for i, r in ((1, None), (2, 1)))
    records = [warc.read_record(p) for p in warc.members(chunks(data, size))]
    assert [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["verified"]) for r in records] == [
        (1, "response", None, 6000, True), (2, "revisit", 1, 6000, True)
    ]


def test_damage_is_noticed():
    payload = b"q" * 500
    good = warc.record_bytes(1, "u", payload, hashlib.sha256(payload).hexdigest(), None)
    changed = next(warc.members(iter([gzip.compress(good.replace(b"qqq\r\n\r\n", b"qqz\r\n\r\n"))])))
    assert not warc.read_record(changed)["verified"]
    for bad in (gzip.compress(good)[:-30], gzip.compress(good[:-100]), gzip.compress(good.replace(b"Content-Length: 500", b"Content-Length: 499")), gzip.compress(b"x\r\n\r\n")):
        with pytest.raises(warc.Damaged):
            for part in warc.members(iter([bad])):
                warc.read_record(part)


def test_very_compressible_payload_in_small_pieces():
    payload = b"0" * 5_000_000
    data = gzip.compress(warc.record_bytes(1, "u", payload, hashlib.sha256(payload).hexdigest(), None))
    for parts in warc.members(chunks(data, 512)):
        assert warc.read_record(parts)["verified"]


def test_urls_are_written_as_they_are():
    assert warc.header_uri("http://a.b/x%20y?q=1&r=%2F#z") == "http://a.b/x%20y?q=1&r=%2F#z"
    assert warc.header_uri("http://a.b/é x\r\n") == "http://a.b/%C3%A9%20x%0D%0A"

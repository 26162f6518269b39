import base64
import hashlib
import struct

import pytest
import zstandard

from quillon.llm import warc
from quillon.llm.common import scratch_path
from quillon.llm.queries import ORACLES
from tests.llm.helpers import SMALL
from tests.oracle import assert_same, connection

PAGES = "page_id long, url string, html string"


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_query_agrees_with_sql(spark):
    assert assert_same(warc.op3_warc(spark, SMALL), connection(SMALL), ORACLES["op3_warc"]) == 50


def test_round_trip_with_edge_cases(spark):
    rows = [(1, "http://a/ b\r\n", "<p>one"), (2, None, "<p>one"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 300_000), (6, "u", "x"), (6, "u", "x"), (None, "n", "<p>one"), (None, None, "solo")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'z' AS payload", "1 AS sha1")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in warc.archive_round_trip(df).collect()), key=repr)
    one, empty, x = b"<p>one", b"", b"x"
    want = [
        (1, "revisit", 2, 6, sha(one), None), (2, "response", None, 6, sha(one), one), (3, "revisit", 4, 0, sha(empty), None), (4, "response", None, 0, sha(empty), empty),
        (5, "response", None, 600_000, sha("é".encode() * 300_000), "é".encode() * 300_000), (6, "response", None, 1, sha(x), x), (6, "revisit", 6, 1, sha(x), None),
        (None, "response", None, 4, sha(b"solo"), b"solo"), (None, "revisit", 2, 6, sha(one), None),
    ]
    assert got == sorted(want, key=repr)
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_archives_begin_with_their_dictionary_and_hold_a_frame_per_record(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    manifest = warc.write_archives(pages, scratch_path(spark, "warc"), archive_bytes=20_000)
    rows = manifest.collect()
    assert sum(r.records for r in rows) == pages.count() and len(rows) > 1
    for r in rows:
        data = open(r.path.removeprefix("file://"), "rb").read()
        assert len(data) == r.bytes
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D and size > 1000
        at, n = 8 + size, 0
        while at < len(data):
            assert data[at : at + 4] == b"\x28\xb5\x2f\xfd"
            d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
            raw = d.decompress(data[at:])
            assert raw.startswith(b"WARC/1.1\r\n")
            at, n = len(data) - len(d.unused_data), n + 1
        assert n == r.records


def record(**change):
    args = {"page_id": 1, "url": "http://x/", "payload": b"abc", "digest": sha(b"abc"), "size": 3, "refers_to": None, "revisit": False} | change
    return warc.encode_record(**args)


def test_records():
    r = warc.decode_record(record())
    assert (r["page_id"], r["record_type"], r["payload"], r["payload_digest"]) == (1, "response", b"abc", sha(b"abc"))
    r = warc.decode_record(record(revisit=True, refers_to=9, page_id=None))
    assert (r["page_id"], r["record_type"], r["payload"], r["refers_to"], r["payload_bytes"]) == (None, "revisit", None, 9, 3)


@pytest.mark.parametrize(
    "bad",
    [
        record()[:-1], record() + b"x", record(digest=sha(b"abd")), record(size=4), record().replace(b"WARC/1.1", b"WARC/9.9"), record().replace(b"WARC-Date:", b"WARC-Nope:"),
        record().replace(b"WARC-Type: response", b"WARC-Type: revisit"), record().replace(b"X-Page-ID: 1", b"no header"), record().replace(b"X-Page-ID: 1", b"WARC-Date: 1"), b"",
    ],
)
def test_broken_records_are_refused(bad):
    with pytest.raises(warc.ArchiveError):
        warc.decode_record(bad)


def test_very_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 7)
    df = spark.range(50).selectExpr("CAST(1 AS long) AS page_id", "'u' AS url", "'<p>x' AS html")
    rows = warc.archive_round_trip(df).groupBy("record_type", "refers_to").count().collect()
    assert {tuple(r) for r in rows} == {("response", None, 1), ("revisit", 1, 49)}


def test_dictionary_may_be_compressed():
    samples = [record(page_id=k, payload=bytes(range(k, k + 99)), size=99) for k in range(99)]
    dictionary = zstandard.train_dictionary(2000, samples).as_bytes()
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    data = warc.dictionary_frame(zstandard.ZstdCompressor().compress(dictionary)) + coder.compress(record(page_id=0)) + coder.compress(record(page_id=1))
    assert [r["page_id"] for r in warc.read_archive(iter([data]))] == [0, 1]
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(iter([warc.dictionary_frame(warc.FRAME_MAGIC + b"broken") + coder.compress(samples[0])])))
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(iter([zstandard.ZstdCompressor().compress(record())[:4] + b"\xff" * 30])))


def test_reading_in_pieces_and_cut_archives():
    frames = b"".join(zstandard.ZstdCompressor().compress(record(page_id=k)) for k in range(5))
    data = warc.dictionary_frame(zstandard.train_dictionary(2000, [record(page_id=k, payload=bytes(range(k, k + 99)), size=99) for k in range(99)]).as_bytes()) + frames
    for step in (1, 7, 1 << 20):
        assert [r["page_id"] for r in warc.read_archive(iter([data[k : k + step] for k in range(0, len(data), step)]))] == list(range(5))
    assert [r["page_id"] for r in warc.read_archive(iter([frames]))] == list(range(5))
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(iter([frames[:-3]])))
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(iter([data[:500]])))

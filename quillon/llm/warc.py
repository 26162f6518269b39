"""WARC archives compressed with Zstandard: one frame per record, and the dictionary of an archive in a
skippable frame at its head.

Writing stores equal payloads once: the record of the largest page_id is the response, the others are
revisit records that name it. Reading loads the dictionary, decodes frame by frame and checks every
record: version line, header syntax, block length, payload length and payload digest.

Archives are written by tasks into the shared folder under names of their own attempt; the manifest, a
written table, lists those of the attempts that counted.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bounded_sample, scratch_path, staged, table

#: Fixed value: magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: Fixed value: the first bytes of a compressed frame.
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
#: The dictionary is trained on about so many pages at most (chosen by hash), each of up to so many bytes.
DICTIONARY_PAGES, DICTIONARY_PAGE_BYTES, DICTIONARY_BYTES = 400, 32_768, 65_536
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 128 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 20
SALTS = 16
#: Equal rows that one row of a plan stands for, at most.
COPIES = 65_536
#: What makes payloads equal: two hashes and the size.
SAME = ("sha1", "check", "size")


class ArchiveError(ValueError):
    """An archive or one of its records is not as it has to be."""


def base32_digest(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>"


def _header_safe(value: str) -> str:
    """White space and control characters would break a header line: they are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" and c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def encode_record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """A response record, or, with ``revisit``, a record without the payload that names the response's page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_safe(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head.append(f"WARC-Profile: {PROFILE}")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> dict:
    """The record in a frame's bytes. Raises ArchiveError at whatever is not as it has to be."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not found or first != "WARC/1.1":
        raise ArchiveError(f"not a record: {first[:40]!r}")
    fields = _fields(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise ArchiveError(f"a record without {name}")
    length = _number(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"{fields['warc-record-id']}: Content-Length {length}, block of {len(rest) - 4}")
    http, found, payload = rest[:length].partition(b"\r\n\r\n")
    status, *lines = http.decode("utf-8").split("\r\n")
    if not found or not status.startswith("HTTP/"):
        raise ArchiveError(f"{fields['warc-record-id']}: no HTTP head in the block")
    size, kind = _number(_fields(lines).get("content-length", "")), fields["warc-type"]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ArchiveError(f"{fields['warc-record-id']}: length or digest of the payload differs")
    elif kind != "revisit" or payload or fields.get("warc-profile") != PROFILE:
        raise ArchiveError(f"{fields['warc-record-id']}: no valid {kind} record")
    page, to = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    return {"page_id": None if page is None else int(page), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": None if to is None else int(to), "payload": payload if kind == "response" else None}


def _fields(lines: list[str]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, found, value = line.partition(":")
        if not found or not name.strip() or name.lower() in out:
            raise ArchiveError(f"not a header line, or twice: {line[:60]!r}")
        out[name.lower()] = value.strip()
    return out


def _number(value: str) -> int:
    if not value.isdigit():
        raise ArchiveError(f"not a length: {value[:40]!r}")
    return int(value)


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


def read_archive(chunks: Iterator[bytes]) -> Iterator[dict]:
    """Records of an archive given in pieces; no more than a record and a piece are held."""
    buffer, ended = b"", False

    def more(n: int) -> bool:
        nonlocal buffer, ended
        while len(buffer) < n and not ended:
            piece = next(chunks, None)
            ended = piece is None
            buffer += piece or b""
        return len(buffer) >= n

    dictionary = None
    if more(8) and struct.unpack("<I", buffer[:4])[0] == DICTIONARY_FRAME:
        size = struct.unpack("<I", buffer[4:8])[0]
        if not more(8 + size):
            raise ArchiveError("the dictionary frame ends early")
        held, buffer = buffer[8 : 8 + size], buffer[8 + size :]
        if held[:4] == FRAME_MAGIC:  # a dictionary may be compressed itself
            try:
                held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
            except zstandard.ZstdError as e:
                raise ArchiveError(f"the dictionary cannot be decompressed: {e}") from e
        dictionary = zstandard.ZstdCompressionDict(held)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while more(1):
        frame, parts = decoder.decompressobj(), []
        while not frame.eof:
            if not more(1):
                raise ArchiveError("the last frame ends early")
            try:
                parts.append(frame.decompress(buffer))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"a frame cannot be decompressed: {e}") from e
            buffer = frame.unused_data if frame.eof else b""
        yield decode_record(b"".join(parts))


def _file_system(uri: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary for the archives; empty where there are too few pages to train one."""
    small = pages.where(F.octet_length("html").between(64, DICTIONARY_PAGE_BYTES)).select(F.xxhash64("html").alias("h"), "html")
    chosen = bounded_sample(small.select("h").distinct(), DICTIONARY_PAGES, 3)
    # equal pages count once; the sample is bounded, and so is each of its pages
    rows = small.join(F.broadcast(chosen), "h").groupBy("h").agg(F.first("html").alias("html")).collect()
    samples = [r["html"].encode() for r in sorted(rows)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _records(pages: DataFrame) -> DataFrame:
    """What to write: one response per payload, with html; revisits without."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("sha1"), F.xxhash64(html).alias("check"), F.octet_length(html).cast("long").alias("size"))
    of = F.max(F.struct("page_id", "url"))
    responses = rows.groupBy(*SAME).agg(F.first("html").alias("html"), of.alias("best"))
    responses = responses.select("best.page_id", "best.url", "html", "sha1", "size", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    # equal rows are counted, so that one of them can be the response; payloads stay out of the join
    rows = rows.select("page_id", "url", *SAME).groupBy("page_id", "url", *SAME).agg(F.count("*").alias("n"))
    shared = rows.groupBy(*SAME).agg(F.max(F.struct("page_id", "url")).alias("best"), F.sum("n").alias("rows")).where("rows > 1").drop("rows")
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of_shared = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(shared.hint("merge"), [*SAME, "salt"])
    is_best = F.col("page_id").eqNullSafe(F.col("best.page_id")) & F.col("url").eqNullSafe(F.col("best.url"))
    again = of_shared.withColumn("n", F.col("n") - is_best.cast("long")).where("n > 0").withColumn("some", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))))
    again = again.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("n") - F.col("some") * COPIES))))
    return responses.unionByName(again.select("page_id", "url", F.lit(None).cast("string").alias("html"), "sha1", "size", F.col("best.page_id").alias("refers_to"), F.lit(True).alias("revisit")))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) and returns the manifest (path, records,
    bytes). A null html is an empty payload; a null url or page_id leaves its header out."""
    dictionary = train_dictionary(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, at = _file_system(folder)
        fs.create_dir(at, recursive=True)
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        out, name, done, written, records = None, "", [], 0, 0

        def close() -> None:
            nonlocal out, written, records
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", records, written))
            out, written, records = None, 0, 0

        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done)}.warc.zst"
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)  # frames are made here, not by the suffix
                    out.write(head := dictionary_frame(dictionary) if dictionary else b"")
                    written = len(head)
                payload = None if r["html"] is None else r["html"].encode()
                frame = coder.compress(encode_record(r["page_id"], r["url"], payload, base32_digest(r["sha1"]), r["size"], r["refers_to"], r["revisit"]))
                out.write(frame)
                written, records = written + len(frame), records + 1
                if written >= archive_bytes:
                    close()
        close()
        paths, counts, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])

    return staged(_records(pages).mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives in ``manifest`` (path), each checked; without ``payloads``, that column is null."""
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, at = _file_system(path)
                with fs.open_input_stream(at, compression=None) as f:
                    rows, held = [], 0
                    for r in read_archive(iter(lambda: f.read(READ_BYTES) or None, None)):
                        if not payloads:
                            r["payload"] = None
                        rows.append(r)
                        held += 200 + len(r["payload"] or b"")
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    yield batch(rows)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Writes all pages to archives in the shared folder and returns what is read back.

    Of equal rows one is the response; an empty table gives no archive and no rows; other columns are ignored."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), payloads)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGIT = "(strpos('0123456789abcdef', substr(h, {}, 1)) - 1)"
OP3_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h,
    row_number() OVER w AS k, first_value(page_id) OVER w AS best
  FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
    ((({_DIGIT.format("1 + i * 5 // 4")} * 16 + {_DIGIT.format("2 + i * 5 // 4")}) >> (3 - i % 4)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k > 1 THEN best END AS refers_to
FROM r
"""

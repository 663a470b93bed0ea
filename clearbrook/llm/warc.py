"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``FRAME`` bytes, frames into
bundles of about ``BUNDLE`` bytes. A bundle ends in a skippable frame with a seek table in
the format of Zstandard's seekable extension: of each frame its compressed and its
plain size. An index maps each record to bundle, frame, offset within the plain frame and
length, so that one record costs one frame.

Bundles are written by the tasks into the folder given, which all executors must share
(a Hadoop path). A bundle stays open over all batches of its task. A task writes under a name
of its own and renames the finished file, and returns the index rows of the files it has
finished; files of failed or repeated attempts are in no index. Memory per task is one batch of
rows and one bundle.

Record ids follow from page_id, url and digest, so that a rerun writes the same records and a
revisit names the response that it refers to.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import join_counted, map_arrow, map_batches, shared_folder, stored

FRAME, BUNDLE, LEVEL = 256 << 10, 16 << 20, 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None, url: str | None, digest: str) -> str:
    """A record's id; rows without page_id are told apart by url. Rows that repeat both are the same record again."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id if page_id is not None else url}:{digest}')}"


def record(kind: str, record_id: str, url: str | None, payload: bytes, digest: str, refers_to: tuple[int, str] | None, n: int) -> bytes:
    """One WARC/1.1 record; a revisit has no block and names the page and the record whose payload it shares."""
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    block = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}"]
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to[1]}>", f"X-Refers-To-Page: {refers_to[0]}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


class Bundle:
    """Frames of one bundle, in memory until it is full."""

    def __init__(self) -> None:
        self.parts, self.sizes, self.open, self.size = [], [], bytearray(), 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, data: bytes) -> tuple[int, int, int]:
        """(frame, offset, length) of the record."""
        at = (len(self.sizes), len(self.open), len(data))
        self.open += data
        if len(self.open) >= FRAME:
            self.close_frame()
        return at

    def close_frame(self) -> None:
        if self.open:
            part = self.packer.compress(bytes(self.open))
            self.parts.append(part)
            self.sizes.append((len(part), len(self.open)))
            self.size += len(part)
            self.open = bytearray()

    def bytes(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.parts) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(data: bytes | memoryview) -> list[tuple[int, int]]:
    """(start, compressed size) of each frame of a bundle, from its footer."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    out, at = [], 0
    for i in range(n):
        size, _ = struct.unpack_from("<II", data, len(data) - 9 - (n - i) * width)
        out.append((at, size))
        at += size
    return out


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages with payload_digest (base32), payload_bytes, and first_id: the smallest page_id of the same payload.

    Payloads smaller than ``least`` bytes are not compared. Frequent payloads, such as the empty
    one, are looked up without a shuffle, so none fills a task.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha1(F.encode(payload, "UTF-8")).alias("sha1"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    first = pages.where(F.col("payload_bytes") >= least).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return join_counted(pages, first, "sha1", F.concat_ws(":", "page_id", "url"))


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write the bundles; returns the index: record_id, page_id, bundle, frame, offset, length.

    Takes page_id, url and html; other columns are ignored. Null html is an empty payload, null url
    an empty target. Rows without page_id are responses. Repeated rows give records of their own,
    under one id where page_id and payload are equal; of rows that share the smallest page_id of a
    payload, all are responses. A very long page is a frame of its own. An empty table writes no bundle.
    """

    def write(batches: Iterator[pa.RecordBatch]):
        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path)
        rows, bundle = [], Bundle()

        def finish():
            name = uuid.uuid4().hex
            with where.open_output_stream(f"{path}/.{name}") as out:
                out.write(bundle.bytes())
            where.move(f"{path}/.{name}", f"{path}/{name}.warc.zst")
            for r in rows:
                r["bundle"] = f"{name}.warc.zst"
            return _columns(rows)

        for batch in batches:
            for page, url, html, sha1, size, first in zip(*(batch.column(i) for i in range(6)), strict=True):
                page, url, first, payload = page.as_py(), url.as_py(), first.as_py(), html.as_buffer().to_pybytes()
                again = page is not None and first is not None and page != first
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                record_id = record_name(page, url, digest)
                data = record("revisit" if again else "response", record_id, url, payload, digest, (first, record_name(first, None, digest)) if again else None, size.as_py())
                frame, offset, length = bundle.add(data)
                rows.append({"record_id": record_id, "page_id": page, "frame": frame, "offset": offset, "length": length})
                if bundle.size >= BUNDLE:
                    yield from finish()
                    rows, bundle = [], Bundle()
        if rows:
            yield from finish()

    planned = plan_records(pages, least).select("page_id", "url", "html", "sha1", "payload_bytes", "first_id")
    return stored(map_batches(planned, _INDEX, write), "warc-index")


def _columns(rows: list[dict]) -> Iterator[dict[str, pa.Array]]:
    if rows:
        table = pa.Table.from_pylist(rows, pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
        yield {c: table[c].combine_chunks() for c in table.column_names}


def read_records(index: DataFrame, folder: str, bundles: DataFrame | None = None) -> DataFrame:
    """The records that the index rows name: page_id, record_id, record_type, payload_digest, payload_bytes, refers_to, block.

    A response's digest and size are taken from its block, and a record that says otherwise is an
    error; those of a revisit are what its header says. Index rows are gathered by bundle and frame, so that a frame is read and unpacked once, and a
    lookup of few records reads few frames.
    """
    frames = index.groupBy("bundle", "frame").agg(F.collect_list(F.struct("page_id", "record_id", "offset", "length")).alias("records"))
    frames = frames.repartition("bundle").sortWithinPartitions("bundle", "frame")

    def read(batch: pa.RecordBatch):
        where, path = fs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor()
        name, source, table, out, size = None, None, [], [], 0
        for bundle, frame, records in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if bundle != name:
                name = bundle
                source = where.open_input_file(f"{path}/{name}")
                total = source.size()
                n = struct.unpack("<IBI", source.read_at(9, total - 9))[0]
                table = seek_table(source.read_at(min(total, 9 + 12 * n), total - min(total, 9 + 12 * n)))
            start, length = table[frame]
            plain = unpack.decompress(source.read_at(length, start))
            for r in records:
                fields, block = parse_record(plain[r["offset"] : r["offset"] + r["length"]])
                digest, size_ = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                if fields["WARC-Type"] == "response" and (base32_sha1(block), len(block)) != (digest, size_):
                    raise ValueError(f"payload of {r['record_id']} is damaged")
                out.append((r["page_id"], r["record_id"], fields["WARC-Type"], digest, size_, int(fields["X-Refers-To-Page"]) if "X-Refers-To-Page" in fields else None, block))
                size += len(block)
            if size > 8 << 20:
                yield from rows(out)
                out, size = [], 0
        yield from rows(out)

    def rows(out):
        if out:
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            names = ("page_id", "record_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "block")
            yield {n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*out, strict=True), strict=True)}

    return map_arrow(frames, "page_id long, record_id string, record_type string, payload_digest string, payload_bytes long, refers_to long, block binary", read)


def archived(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages as archives into the shared folder and read every record back."""
    folder = shared_folder(spark, "warc")
    return read_records(write_archives(pages, folder, least), folder)


def query(spark, sf_dir: str) -> DataFrame:
    """What the archives give back; the digest of each response is recomputed from its block."""
    got = archived(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS x FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x, payload_bytes) AS first_id FROM h),
d AS (SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(((CAST('0x' || substr(x, CAST(k // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) + 1 AS INTEGER), 1)
  FOR k IN range(32)], '') AS payload_digest FROM f)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d
"""

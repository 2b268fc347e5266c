"""Seekable Zstandard WARC bundles.

Records are grouped into independent Zstandard frames; a bundle ends with the seek table of the public seekable format (a
skippable frame that lists each frame's compressed and plain size), so any Zstandard reader unpacks it as one WARC file
and a seeking reader fetches the footer and then single frames. The index maps a record's identifier to its bundle, frame
and place within the plain frame.

Payloads that occur again are revisit records that refer to the record with the smallest page_id. Which records are
revisits is settled on narrow rows (page_id and digests) before any payload moves.

Defined results: a null html is an empty payload; a null url is an empty target; rows that repeat both page_id and payload
of the first record are one record written again, hence responses too; a null page_id sorts after all others and is read
back as null; an empty table makes no bundle and an empty index. Extra columns are ignored.

A task writes its bundles under names of its own and moves each into place when it is whole, so a task that runs again
replaces them. At most one frame (and one record) is held in memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir, small_batches, table

#: Plain bytes after which a frame ends, and compressed bytes after which a bundle ends.
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 64 << 20, 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:lectern:page:"
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\U0010ffff]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- records -----------------------------------------------------------------------------------------------------------


def _uri(url: str | None) -> str:
    return _UNSAFE.sub(lambda m: "".join(f"%{x:02X}" for x in m[0].encode("utf-8", "surrogatepass")), url or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """One WARC record; a revisit, which has no payload, if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in raw.decode().split("\r\n")[1:])


def _page(urn: str) -> int | None:
    number = urn.strip("<>")[len(_URN) :]
    return int(number) if number else None


def parse(frame: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at an offset of a plain frame, and the offset after it. The digest of a payload that is there is checked."""
    end = frame.index(b"\r\n\r\n", at)
    head = _headers(frame[at:end])
    block = frame[end + 4 : end + 4 + int(head["Content-Length"])]
    cut = block.index(b"\r\n\r\n") + 4
    http = _headers(block[: cut - 4])
    kind, said = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block[cut:] if kind == "response" else None
    if payload is not None and (digest(payload) != said or len(payload) != int(http["Content-Length"])):
        raise ValueError(f"the payload of {head['WARC-Record-ID']} doesn't match its digest")
    out = {
        "page_id": _page(head["WARC-Record-ID"]),
        "url": head["WARC-Target-URI"],
        "payload": payload,
        "payload_bytes": int(http["Content-Length"]),
        "payload_digest": said,
        "record_type": kind,
        "refers_to": _page(head["WARC-Refers-To"]) if kind == "revisit" else None,
    }
    return out, end + 8 + len(block)


# -- bundles -----------------------------------------------------------------------------------------------------------


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer: (compressed, plain) size of each frame."""
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


class Bundle:
    """Reads a bundle by seeking: the footer first, then the frames that are asked for."""

    def __init__(self, uri: str):
        store, path = _store(uri)
        self.file = store.open_input_file(path)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        width = 12 if flags & 0x80 else 8
        rows = self.file.read_at(n * width, end - 9 - n * width)
        self.frames, at = [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", rows, k * width)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)

    def record(self, frame: int, offset: int) -> dict:
        return parse(self.frame(frame), offset)[0]

    def __iter__(self) -> Iterator[dict]:
        for k in range(len(self.frames)):
            plain, at = self.frame(k), 0
            while at < len(plain):
                row, at = parse(plain, at)
                yield row

    def close(self) -> None:
        self.file.close()


class _Writer:
    """One task's bundles. Rows of the index come out of add() and close() once their frame is written."""

    def __init__(self, folder: str, part: int, frame_bytes: int, bundle_bytes: int):
        self.folder, self.part, self.frame_bytes, self.bundle_bytes = folder, part, frame_bytes, bundle_bytes
        self.store, self.path = _store(folder)
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.count, self.out, self.sizes, self.held, self.size, self.written = 0, None, [], [], 0, 0

    def _name(self) -> str:
        return f"part-{self.part:06d}-{self.count:05d}.warc.zst"

    def add(self, page_id: int | None, raw: bytes) -> list[tuple]:
        self.held.append((page_id, self.size, raw))
        self.size += len(raw)
        return self._frame() if self.size >= self.frame_bytes else []

    def _frame(self) -> list[tuple]:
        if not self.held:
            return []
        if self.out is None:
            self.tried = f"{self.path}/.{self._name()}.{uuid.uuid4().hex}"
            self.out = self.store.open_output_stream(self.tried, compression=None)
        packed = self.squeeze.compress(b"".join(x[2] for x in self.held))
        self.out.write(packed)
        rows = [(p, f"{self.folder}/{self._name()}", len(self.sizes), at, len(raw)) for p, at, raw in self.held]
        self.sizes.append((len(packed), self.size))
        self.written += len(packed)
        self.held, self.size = [], 0
        if self.written >= self.bundle_bytes:
            self._bundle()
        return rows

    def _bundle(self) -> None:
        if self.out is not None:
            self.out.write(seek_table(self.sizes))
            self.out.close()
            self.store.move(self.tried, f"{self.path}/{self._name()}")
            self.count += 1
            self.out, self.sizes, self.written = None, [], 0

    def close(self) -> list[tuple]:
        rows = self._frame()
        self._bundle()
        return rows


INDEX = "page_id long, bundle string, frame long, record_offset long, record_bytes long"


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """records: page_id, url, html, refers_to (null: response). Writes bundles into folder and returns their written index."""
    spark = records.sparkSession
    small_batches(spark)
    _store(folder)[0].create_dir(_store(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder, TaskContext.get().partitionId(), frame_bytes, bundle_bytes)

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

        for b in batches:
            found = []
            for page, url, html, first in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                found += out.add(page, record(page, url, (html or "").encode("utf-8", "surrogatepass"), first))
            yield rows(found)
        yield rows(out.close())

    picked = records.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.col("refers_to").cast("long"))
    return materialise(picked.mapInArrow(run, INDEX), "warc-index")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read_bundles(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the bundles that an index names, parsed from the archives. Payloads of responses only, if asked for."""
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], k) for n, k in zip(names, kinds, strict=True)], names=names)
            held.clear()
            return out

        for b in batches:
            for uri in b.column(0).to_pylist():
                bundle = Bundle(uri)
                for row in bundle:
                    if not with_payload:
                        row["payload"] = None
                    held.append(row)
                    size += row["payload_bytes"]
                    if len(held) >= 2000 or with_payload and size > 8 << 20:
                        yield flush()
                        size = 0
                bundle.close()
        yield flush()

    bundles = index.select("bundle").distinct()
    return bundles.repartition(max(1, bundles.count())).mapInArrow(run, READ)  # else few rows would be few tasks


def lookup(index: DataFrame, page_id: int) -> list[dict]:
    """Records of an identifier: one frame of one bundle is fetched for each."""
    out = []
    for r in index.where(F.col("page_id") == page_id).collect():
        bundle = Bundle(r.bundle)
        out.append(bundle.record(r.frame, r.record_offset))
        bundle.close()
    return out


# -- which records are revisits ----------------------------------------------------------------------------------------


def _keys(html: Column) -> list[Column]:
    raw = F.coalesce(html.cast("string"), F.lit("")).cast("binary")
    return [F.sha1(raw).alias("__w_sha1"), F.xxhash64(raw).alias("__w_xx"), F.octet_length(raw).cast("long").alias("__w_n")]


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, __w_*: payload keys, refers_to: the records whose payload a record of smaller page_id has.

    The minimum is combined before it is shuffled, so a payload that a third of all pages have is one row per task.
    """
    keys = ["__w_sha1", "__w_xx", "__w_n"]
    narrow = materialise(pages.select(F.col("page_id").cast("long").alias("page_id"), *_keys(F.col("html"))).where(F.col("__w_n") >= min_bytes), "warc-keys")
    first = narrow.groupBy(*keys).agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("__w_c")).where("__w_c > 1").drop("__w_c")
    later = narrow.join(first, keys).where(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return materialise(later.distinct(), "warc-revisits")


def write_pages(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write each page as a record, with revisits for payloads of min_bytes or more; returns the index."""
    again = revisits(pages, min_bytes)
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", *_keys(F.col("html")))
    same = [keyed[c].eqNullSafe(again[c]) for c in ("page_id", "__w_sha1", "__w_xx", "__w_n")]
    joined = keyed.join(again, same[0] & same[1] & same[2] & same[3], "left")
    return write_bundles(joined.select(keyed["page_id"], "url", "html", "refers_to"), folder)


def op1_warc_seekable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as seekable bundles, then every record read back from the archives."""
    index = write_pages(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BITS = "array_to_string(list_transform(generate_series(1, 40), lambda i: right('000' || bin(strpos('0123456789abcdef', substr(sha1(p), i, 1)) - 1), 4)), '')"
OP1_SQL = f"""WITH raw AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
bits AS (SELECT page_id, p, strlen(p) AS n, {_BITS} AS b, min(page_id) OVER (PARTITION BY p) AS first FROM raw)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('{_B32}', 1 +
    16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT
    + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM bits"""

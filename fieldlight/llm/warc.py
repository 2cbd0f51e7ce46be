"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of a few hundred KB; a bundle is frames, then an index
frame (skippable, JSON: record id to frame and offset inside the frame) and the public seek table
as the last skippable frame. One record needs the seek table and one frame only. Bundles are rows
with a binary column, so Spark itself writes and commits them to any store.

Payload bytes that occur more than once are stored once: the record with the least id is the
response, the others are revisits that name it. Ids are found by a pre-aggregated minimum per
digest; hot digests are only ever joined as narrow rows, which adaptive execution may split.

Nulls and repeats: null html is an empty payload, null url an empty target; a null id is written
as an empty id and is a response; rows that share the least id and payload are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import packed_up, unpacked_as

#: Bytes of records in a frame and of a bundle before compression.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
#: Fixed numbers of the public seekable format.
SKIPPABLE, SEEK_MAGIC, INDEX = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
_EPOCH = "1970-01-01T00:00:00Z"
BUNDLE_DDL = "bundle long, records long, content binary"
RECORD_DDL = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(text: str) -> str:
    """A header value in one line: percent for control characters."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 or c == "%" else c for c in text)


def _plain(text: str) -> str:
    parts = text.split("%")
    return parts[0] + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts[1:])


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, payload_digest: str) -> bytes:
    """One WARC/1.1 record. A revisit has no block; its headers keep the full payload's length and digest."""
    body = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_EPOCH}",
        f"WARC-Target-URI: {_safe(url)}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-X-Payload-Length: {len(payload)}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def bundle(records: list[tuple[str, bytes]], frame_bytes: int = FRAME_BYTES) -> bytes:
    """Frames of whole records, the index and the seek table."""
    press = zstandard.ZstdCompressor(level=3, write_content_size=True)
    frames: list[tuple[bytes, int]] = []
    index: list[tuple[str, int, int]] = []
    now: list[bytes] = []
    held = 0

    def close() -> None:
        nonlocal held
        if now:
            raw = b"".join(now)
            frames.append((press.compress(raw), len(raw)))
            now.clear()
            held = 0

    for name, raw in records:
        index.append((name, len(frames), held))
        now.append(raw)
        held += len(raw)
        if held >= frame_bytes:
            close()
    close()
    names = zstandard.ZstdCompressor().compress(json.dumps(index).encode())
    entries = [(len(c), n) for c, n in frames] + [(len(names) + 8, 0)]
    table = b"".join(struct.pack("<II", *e) for e in entries) + struct.pack("<IBI", len(entries), 0, SEEK_MAGIC)
    return b"".join([*(c for c, _ in frames), struct.pack("<II", INDEX, len(names)), names, struct.pack("<II", SKIPPABLE, len(table)), table])


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed bytes, bytes) of each frame, from the footer."""
    count, _, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table at the end")
    out, at = [], 0
    for k in range(count):
        size, raw = struct.unpack_from("<II", content, len(content) - 9 - 8 * (count - k))
        out.append((at, size, raw))
        at += size
    return out


def _frame(content: bytes, frames: list[tuple[int, int, int]], k: int) -> bytes:
    at, size, _ = frames[k]
    return zstandard.ZstdDecompressor().decompress(content[at : at + size])


def index_of(content: bytes) -> list[tuple[str, int, int]]:
    """Record id, frame and offset inside the frame, in order."""
    at, size, _ = seek_table(content)[-1]
    return [tuple(x) for x in json.loads(zstandard.ZstdDecompressor().decompress(content[at + 8 : at + size]))]


def seek(content: bytes, name: str) -> bytes | None:
    """The record with this id: one frame is decompressed."""
    frames = seek_table(content)
    for own, k, offset in index_of(content):
        if own == name:
            return _one(_frame(content, frames, k), offset)[0]
    return None


def _one(raw: bytes, at: int) -> tuple[bytes, int]:
    head = raw.index(b"\r\n\r\n", at) + 4
    size = int(raw[at:head].rpartition(b"Content-Length: ")[2])
    return raw[at : head + size], head + size + 4


def parse(raw: bytes) -> dict:
    """The columns of one record."""
    head, _, body = raw.partition(b"\r\n\r\n")
    h = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    own, target = (h.get(k, "<urn:page:>")[10:-1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
    if h["WARC-Type"] == "response" and digest(body) != h["WARC-Payload-Digest"][5:]:
        raise ValueError(f"payload of {own} does not have its digest")
    return {
        "page_id": int(own) if own else None, "url": _plain(h["WARC-Target-URI"]), "record_type": h["WARC-Type"], "refers_to": int(target) if target else None,
        "payload_bytes": int(h["WARC-X-Payload-Length"]), "payload_digest": h["WARC-Payload-Digest"][5:], "payload": body if h["WARC-Type"] == "response" else None,
    }


def with_originals(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Adds refers_to: the least id with the same payload, null for that row itself and for payloads under least_bytes.

    Ids may have any type that has an order; other columns pass through, whatever their names. A column refers_to is replaced.
    """
    pages = pages.drop("refers_to")
    rows, payload = packed_up(pages, html_col), F.coalesce("_text", F.lit(""))
    narrow = rows.select(F.col("_doc")[id_col].alias("_id"), F.sha1(payload).alias("_digest"), F.octet_length(payload).alias("_n")).where("_id IS NOT NULL")
    first = narrow.where(F.col("_n") >= least_bytes).groupBy("_digest").agg(F.min("_id").alias("refers_to"), F.count("*").alias("_c")).where("_c > 1").drop("_c")
    again = narrow.join(first, "_digest").where("_id <> refers_to").select("_id", "_digest", "refers_to").distinct()
    marked = rows.withColumn("_digest2", F.sha1(payload))
    out = marked.join(again, (F.col("_doc")[id_col] == F.col("_id")) & (F.col("_digest2") == F.col("_digest")), "left")
    return out.select(*unpacked_as(pages, html_col), "refers_to")


def write_bundles(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0,
    frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """Rows of bundles (bundle, records, content) that hold one record per page.

    Ids are integers that fit a long, or null; another type is refused with a TypeError before any work. Other columns are not
    read. A frame closes after the record that fills it, so it is as large as frame_bytes and its last record.
    """
    if not isinstance(pages.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer column, not {pages.schema[id_col].dataType.simpleString()}")
    rows = with_originals(pages, id_col=id_col, html_col=html_col, least_bytes=least_bytes).select(F.col(id_col).cast("string"), url_col, html_col, F.col("refers_to").cast("string"))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 33
        held: list[tuple[str, bytes]] = []
        size = 0

        def out() -> pd.DataFrame:
            nonlocal number, size
            made = pd.DataFrame({"bundle": [number], "records": [len(held)], "content": [bundle(held, frame_bytes)]})
            number += 1
            size = 0
            held.clear()
            return made

        for frame in frames:
            for page, url, html, original in frame.itertuples(index=False):
                payload = html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b""
                page = None if pd.isna(page) else int(page)
                raw = record(page, url if isinstance(url, str) else "", payload, None if pd.isna(original) else int(original), digest(payload))
                held.append(("" if page is None else str(page), raw))
                size += len(raw)
                if size >= bundle_bytes:
                    yield out()
        if held:
            yield out()

    return rows.mapInPandas(each, BUNDLE_DDL)


def read_bundles(bundles: DataFrame, *, content_col: str = "content", payloads: bool = True) -> DataFrame:
    """The records of bundles; content_col may also be that of Spark's binaryFile source."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame[content_col]:
                content = bytes(content)
                table = seek_table(content)
                for k in range(len(table) - 1):
                    raw, at, rows = _frame(content, table, k), 0, []
                    while at < len(raw):
                        one, at = _one(raw, at)
                        rows.append(parse(one) | ({} if payloads else {"payload": None}))
                    made = pd.DataFrame(rows)
                    yield made.astype({"page_id": "Int64", "refers_to": "Int64"})

    return bundles.select(content_col).mapInPandas(each, RECORD_DDL)

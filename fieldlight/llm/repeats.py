"""Passages that repeat across documents, found through content-chosen anchors.

A window is L consecutive units (bytes or words). Its anchor is the place, inside it, of the
smallest hash of K consecutive units (leftmost of equals), so equal windows have their anchor at
the same place. Work goes by anchors, about one for every (L - K) / 2 units:

1. Documents are packed into compressed chunks, stored once in the shared folder.
2. Hashes at anchors meet in buckets; those seen in two different texts survive. A hash that many
   documents of a chunk share is sent once for the chunk, so no common passage makes a hot bucket.
3. Chunks send the surroundings of surviving anchors (all windows that have the anchor) to buckets:
   equal surroundings once per chunk, with the least document id that has them there. A bucket
   finds, for every window, the least document id that has it; how is up to the caller. It answers
   a chunk with the windows that an earlier document outside the chunk has.
4. An anchor with very many different surroundings, each counted once for a chunk, would make a bucket of them
   all. Its windows go one by one instead: the least id of each 128-bit digest, one row for a chunk and digest.
   That is several times as much as surroundings, so the number of chunks alone does not decide it.
5. Chunks compare their own occurrences with the answers, and cut the runs of units out.

Exact copies of a text with a smaller id are known from a narrow grouped minimum of digests, one row
for a chunk and digest: every window of theirs is repeated, so they take no part in steps 3 to 5. Joins
are on chunk numbers or digests; nothing is collected and no step holds more than a chunk or a bucket. Shuffle
files of steps 2 to 4 go with the step; the result reads the chunks, the surviving hashes and the answers.

Ids must be integers that fit a long. Rows with a null id are neither earlier nor later than any other:
nothing is cut from them. Columns besides the id and the text, whatever their names, are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, shuffles_removed, stored, texts_of

#: Bytes of text in a chunk, in the share of a hash bucket and of a bucket of surroundings.
CHUNK_BYTES = 2 << 20
HASH_BUCKET_BYTES = 24 << 20
BUCKET_BYTES = 8 << 20
#: Rows of a chunk at most, for rows with little text.
CHUNK_ROWS = 1 << 16
#: Surroundings of one anchor's hash, each counted once for a chunk that has it, from which its windows go one by one.
HOT_CHUNKS = 1 << 16
#: Occurrences of a hash in a chunk up to which each counts as a surrounding of its own.
FEW = 4
#: Anchors whose leading bytes each chunk adds to the sample for splitters.
SAMPLE = 32
SEGMENT = 1 << 17
#: Occurrences of a bucket whose windows are compared at once.
PART = 1 << 14
LOW48 = np.uint64((1 << 48) - 1)
LOW32 = np.uint64(0xFFFFFFFF)
NO_ID = np.iinfo(np.int64).max
CHUNK_DDL = "chunk long, ids array<long>, kinds array<int>, digests array<binary>, leasts array<long>, leads array<binary>, n_bytes long, data binary"
LEAD = 16


def packed(*arrays: np.ndarray | bytes, level: int = 1) -> bytes:
    """Arrays as one compressed string."""
    raw = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=level).compress(b"".join([struct.pack(f"<{len(raw)}Q", *map(len, raw)), *raw]))


def unpacked(data: bytes, *kinds: str | None) -> list:
    """What packed() was given; kinds are dtypes, None for bytes."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 8 * len(kinds), []
    for size, kind in zip(struct.unpack_from(f"<{len(kinds)}Q", raw), kinds, strict=True):
        out.append(raw[at : at + size] if kind is None else np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


@dataclass
class Units:
    """The units of a chunk's documents, one after the other."""

    tokens: np.ndarray  # one number per unit
    begins: np.ndarray  # first unit of each document, and the number of units
    data: bytes  # their text
    places: np.ndarray | None  # where each unit begins in data (None: unit i at byte i)
    ends: np.ndarray | None

    def slices(self, first: np.ndarray, last: np.ndarray) -> tuple[list[int], list[int]]:
        """Byte ranges from unit first to unit last, included."""
        if self.places is None:
            return first.tolist(), (last + 1).tolist()
        return self.places[first].tolist(), self.ends[last].tolist()


def byte_units(texts: list[bytes]) -> Units:
    data = b"".join(texts)
    return Units(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, texts)]), data, None, None)


def word_units(texts: list[bytes]) -> Units:
    words = [t.split() for t in texts]
    flat = [w for ws in words for w in ws]
    tokens = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat))
    ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1) - 1
    places = np.r_[0, ends[:-1] + 1] if len(flat) else ends
    return Units(tokens, np.cumsum([0, *map(len, words)]), b" ".join(flat), places, ends)


_TABLE = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_FACTOR = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def rolling(tokens: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of every k consecutive units."""
    x = _TABLE[tokens] if tokens.dtype == np.uint8 else tokens
    n, out, done, step = 1, None, 0, _FACTOR
    size = len(tokens) - k + 1
    while n <= k:  # doubling: a run of 2n is two runs of n
        if k & n:
            part = x[done : done + size]
            out = part if out is None else out * np.uint64(step) + part
            done += n
        if 2 * n <= k:
            x = x[:-n] * np.uint64(step) + x[n:]
        step = step * step & _ALL
        n *= 2
    out = out ^ (out >> np.uint64(29))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        x, n = np.minimum(x[:-n], x[n:]), 2 * n
    return np.minimum(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


def anchors(units: Units, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window, number of windows) of each anchor; windows never cross documents."""
    out: list[tuple[np.ndarray, ...]] = []
    total = len(units.tokens) - length + 1
    room = np.repeat(units.begins[1:], np.diff(units.begins))  # where each unit's document ends
    for s in range(0, max(total, 0), SEGMENT):
        e = min(s + SEGMENT, total)
        g = rolling(units.tokens[s : e + length - 1], k)
        code = (g & ~LOW32) | np.arange(len(g), dtype=np.uint64)
        at = (sliding_min(code, length - k + 1) & LOW32).astype(np.int64)
        ok = np.flatnonzero(room[s:e] - np.arange(s, e) >= length)
        if not len(ok):
            continue
        at = at[ok]
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (ok[1:] != ok[:-1] + 1)])
        out.append((at[new] + s, g[at[new]], ok[new] + s, np.diff(np.r_[new, len(ok)])))
    if not out:
        return (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def leading(units: Units, at: np.ndarray) -> np.ndarray:
    """The first bytes at each unit, which sort as they are."""
    raw = np.frombuffer(units.data + bytes(LEAD), np.uint8)
    at = at if units.places is None else units.places[at]
    return np.ascontiguousarray(raw[at[:, None] + np.arange(LEAD)]).view(f"S{LEAD}")[:, 0]


@dataclass
class Surroundings:
    """What a bucket of step 3 gets: distinct contexts per chunk, and where they occur."""

    texts: list[bytes]
    anchor: np.ndarray  # units before the anchor
    windows: np.ndarray  # windows of the context; it has length - 1 units more
    ids: np.ndarray  # least document id that has it in its chunk


Least = Callable[[Surroundings], np.ndarray]  # (contexts, most windows): least id that has each window


def repeats(
    docs: DataFrame, *, id_col: str, text_col: str, length: int, k: int, units: Callable[[list[bytes]], Units], least: Least, by_range: bool
) -> DataFrame:
    """(id, n_units, n_removed, runs, kept): kept is the bytes of the units left, words joined by a space."""
    if not 0 < k <= length < 1 << 15:
        raise ValueError("0 < k <= length < 32768")
    spark = docs.sparkSession
    with shuffles_removed(spark):
        asked, seek = _answered(docs, id_col, text_col, length, k, units, least, by_range)
    ddl = f"`{id_col}` long, n_units long, n_removed long, runs array<struct<begin:long,end:long>>, kept binary"
    return asked.mapInArrow(_cut_out(id_col, seek), ddl)


def _answered(docs: DataFrame, id_col: str, text_col: str, length: int, k: int, units: Callable, least: Least, by_range: bool) -> tuple[DataFrame, "_Seek"]:
    """Chunks beside all that they are told by others."""
    spark = docs.sparkSession
    chunks = stored(_chunks(docs, id_col, text_col, length, k, units), "chunks")
    size = chunks.agg(F.sum("n_bytes")).head()[0] or 0
    n_hash, n_near = (max(partitions(spark), size // b + 1) for b in (HASH_BUCKET_BYTES, BUCKET_BYTES))
    split = np.empty(0, f"S{LEAD}")
    if by_range:  # one splitter a bucket
        edges = chunks.select(F.explode("leads").alias("lead")).repartitionByRange(n_near, "lead").groupBy(F.spark_partition_id().alias("p")).agg(F.min("lead").alias("lead"))
        split = np.unique(np.array([bytes(r.lead) for r in edges.collect()], f"S{LEAD}"))[1:]

    narrow = chunks.select("chunk", F.posexplode(F.arrays_zip("digests", "leasts")).alias("kind", "d")).select("chunk", "kind", "d.digests", "d.leasts").where("leasts IS NOT NULL")
    first = narrow.groupBy("digests").agg(F.min("leasts").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    earlier = narrow.join(first, "digests").where("leasts > first").groupBy("chunk").agg(F.collect_list(F.struct("kind", "first")).alias("earlier"))

    hashes = chunks.select("chunk", "data").mapInArrow(_send_hashes(length, k, units, n_hash), "bucket int, chunk long, data binary")
    alive = hashes.groupBy("bucket").applyInArrow(_surviving(HOT_CHUNKS), "chunk long, data binary, hot boolean")
    alive = stored(alive.groupBy("chunk").agg(F.collect_list("data").alias("alive"), F.bool_or("hot").alias("hot")), "alive")

    seek = _Seek(length, k, units, n_near, split, by_range)
    asked = chunks.select("chunk", "ids", "kinds", "leasts", "data").join(alive, "chunk", "left").join(earlier, "chunk", "left")
    sent = asked.where("alive IS NOT NULL").mapInArrow(_send_contexts(seek), "bucket int, chunk long, data binary")
    back = sent.groupBy("bucket").applyInArrow(_answers(least), "chunk long, bucket int, data binary")
    back = stored(back.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "data")).alias("back")), "back")
    windows = F.lit(None).cast("array<struct<digest:binary,first:long>>").alias("windows")
    if alive.where("hot").isEmpty():
        return asked.join(back, "chunk", "left").select("*", windows), seek
    apart = asked.where("hot").select("*", F.lit(None).cast("array<struct<bucket:int,data:binary>>").alias("back"), windows)
    apart = apart.mapInArrow(_send_windows(seek), "chunk long, digest binary, id long")
    found = apart.withColumn("first", F.min("id").over(Window.partitionBy("digest"))).where("first < id")  # shuffled once
    found = stored(found.groupBy("chunk").agg(F.collect_list(F.struct("digest", "first")).alias("windows")), "windows")
    return asked.join(back, "chunk", "left").join(found, "chunk", "left"), seek


def _chunks(docs: DataFrame, id_col: str, text_col: str, length: int, k: int, units: Callable) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def out() -> pa.RecordBatch:
            nonlocal held, number
            own = units(texts)
            at = anchors(own, length, k)[0]
            leads = leading(own, np.sort(at)[:: max(1, len(at) // SAMPLE)]) if len(at) else np.empty(0, f"S{LEAD}")
            leads = [x.ljust(LEAD, b"\0") for x in leads.tolist()]
            places: dict[bytes, int] = {}
            kinds = [places.setdefault(xxhash.xxh3_128_digest(t), len(places)) for t in texts]
            leasts: list[int | None] = [None] * len(places)
            for i, kind in zip(ids, kinds, strict=True):
                if i is not None and (leasts[kind] is None or i < leasts[kind]):
                    leasts[kind] = i
            data = packed(np.array(list(map(len, texts)), np.int64), b"".join(texts), level=5)  # shuffled again
            row = [number], [list(ids)], [kinds], [list(places)], [leasts], [leads], [held], [data]
            types = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.int64(), pa.binary()
            ids.clear(), texts.clear()
            number, held = number + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], names=["chunk", "ids", "kinds", "digests", "leasts", "leads", "n_bytes", "data"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), texts_of(batch, text_col), strict=True):
                ids.append(i), texts.append(text)
                held += len(text)
                if held >= CHUNK_BYTES or len(ids) >= CHUNK_ROWS:
                    yield out()
        if ids:
            yield out()

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(each, CHUNK_DDL)


def _texts(data: bytes) -> list[bytes]:
    sizes, joined = unpacked(data, "<i8", None)
    ends = np.cumsum(sizes).tolist()
    return [joined[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"bucket": pa.int32(), "chunk": pa.int64(), "data": pa.binary(), "hot": pa.bool_(), "digest": pa.binary(), "id": pa.int64()}
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, types[n]) for c, n in zip(columns, names, strict=True)], names=names)


def _bucket(g: np.ndarray, n: int) -> np.ndarray:
    """By low bits: anchors are minima, so the high bits of their hashes are all small."""
    return ((g & LOW32) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _spans(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal numbers."""
    if not len(sorted_):
        return []
    edges = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]).tolist()
    return list(zip(edges, [*edges[1:], len(sorted_)], strict=True))


def _send_hashes(length: int, k: int, units: Callable, n: int) -> Callable:
    """Distinct anchor hashes of a chunk, with the number of their surroundings; owner 0 means that two texts of the chunk have it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                texts = _texts(data.as_py())
                own = units(texts)
                at, g, first, windows = anchors(own, length, k)
                owner = np.array([xxhash.xxh64_intdigest(t) or 1 for t in texts], np.uint64)
                owner = owner[np.searchsorted(own.begins, at, "right") - 1]
                order = np.lexsort((owner, g))
                g, owner = g[order], owner[order]
                heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
                many = np.add.reduceat(np.r_[False, (g[1:] == g[:-1]) & (owner[1:] != owner[:-1])], heads) > 0 if len(g) else heads
                kinds = np.diff(np.r_[heads, len(g)])
                for h in np.flatnonzero(kinds > FEW).tolist():
                    i = order[heads[h] : heads[h] + kinds[h]]
                    begin, end = own.slices(first[i], first[i] + windows[i] + length - 2)
                    kinds[h] = len({(own.data[x:y], z) for x, y, z in zip(begin, end, (at[i] - first[i]).tolist(), strict=True)})
                g, owner = g[heads], np.where(many, np.uint64(0), owner[heads])
                bucket = _bucket(g, n)
                order = np.lexsort((owner, bucket))
                g, owner, bucket, kinds = g[order], owner[order], bucket[order], kinds[order]
                rows = []
                for a, b in _spans(bucket):
                    low = np.ascontiguousarray((g[a:b] & LOW48).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
                    starts = np.flatnonzero(np.r_[True, owner[a + 1 : b] != owner[a : b - 1]])
                    rows.append((int(bucket[a]), chunk, packed(owner[a:b][starts], np.diff(np.r_[starts, b - a]).astype("<u4"), low, kinds[a:b].astype("<u4"))))
                yield _rows(rows, ["bucket", "chunk", "data"])

    return each


def _surviving(most: int) -> Callable:
    """Hashes of a bucket that two different texts have, back to the chunks they came from; hot: chunks have so many surroundings of one."""

    def each(group: pa.Table) -> pa.Table:
        chunks, hashes, owners, kinds = [], [], [], []
        for chunk, data in zip(group["chunk"].to_pylist(), group["data"], strict=True):
            owner, counts, low, own = unpacked(data.as_py(), "<u8", "<u4", "u1", "<u4")
            wide = np.zeros((len(low) // 6, 8), np.uint8)
            wide[:, :6] = low.reshape(-1, 6)
            hashes.append(wide.view("<u8")[:, 0]), owners.append(np.repeat(owner, counts)), chunks.append(np.full(len(wide), chunk)), kinds.append(own)
        h, owner, chunk, kind = (np.concatenate(x) for x in (hashes, owners, chunks, kinds))
        order = np.argsort(h, kind="stable")
        h, owner, chunk, kind = h[order], owner[order], chunk[order], kind[order]
        heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        low, high = np.minimum.reduceat(owner, heads), np.maximum.reduceat(owner, heads)
        times = np.diff(np.r_[heads, len(h)])
        alive, hot = np.repeat((low != high) | (low == 0), times), np.repeat(np.add.reduceat(kind.astype(np.int64), heads) >= most, times)
        h, chunk, hot = h[alive], chunk[alive], hot[alive]
        order = np.argsort(chunk, kind="stable")
        h, chunk, hot = h[order], chunk[order], hot[order]
        rows = [(int(chunk[a]), packed(h[a:b], hot[a:b].astype(np.uint8)), bool(hot[a:b].any())) for a, b in _spans(chunk)]
        return pa.Table.from_batches([_rows(rows, ["chunk", "data", "hot"])])

    return each


@dataclass
class _Seek:
    """How a chunk finds its surviving anchors again: the same in every step."""

    length: int
    k: int
    units: Callable
    buckets: int
    split: np.ndarray
    by_range: bool

    def anchors(self, row: dict) -> tuple["_Found", "_Found"]:
        """Occurrences of surviving anchors outside copies: those in surroundings, and those of hot anchors."""
        own = self.units(_texts(row["data"]))
        at, g, first, windows = anchors(own, self.length, self.k)
        doc = np.searchsorted(own.begins, at, "right") - 1
        ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
        out_of = copies_of(row) | np.array([i is None for i in row["ids"]], bool)
        parts = [unpacked(d, "<u8", "u1") for d in row["alive"] or []]
        alive, hot = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, t) for i, t in ((0, np.uint64), (1, np.uint8)))
        order = np.argsort(alive)
        alive, hot = np.r_[alive[order], np.uint64(_ALL)], np.r_[hot[order], np.uint8(0)]  # the last is no hash of 48 bits
        place = np.searchsorted(alive, g & LOW48)
        keep = (alive[place] == g & LOW48) & ~out_of[doc]
        made = []
        for some in (keep & (hot[place] == 0), keep & (hot[place] == 1)):
            i = np.flatnonzero(some)
            made.append(_Found(own, at[i], g[i], first[i], windows[i], doc[i], ids[doc[i]]))
        return made[0], made[1]

    def contexts(self, f: "_Found") -> Iterator[tuple[int, dict[tuple[bytes, int], list[int]]]]:
        """Per bucket: the distinct surroundings (text, units before the anchor) with their occurrences."""
        bucket = np.searchsorted(self.split, leading(f.own, f.at), "right") if self.by_range else _bucket(f.g, self.buckets)
        order = np.argsort(bucket, kind="stable")
        begin, end = f.own.slices(f.first, f.first + f.windows + self.length - 2)
        before = (f.at - f.first).tolist()
        for a, b in _spans(bucket[order]):
            seen: dict[tuple[bytes, int], list[int]] = {}
            for i in order[a:b].tolist():
                seen.setdefault((f.own.data[begin[i] : end[i]], before[i]), []).append(i)
            yield int(bucket[order[a]]), seen

    def digests(self, f: "_Found") -> tuple[np.ndarray, list[bytes]]:
        """(occurrence, digest) of each window of hot anchors."""
        which = np.repeat(np.arange(len(f.at)), f.windows)
        start = f.first[which] + np.arange(len(which)) - np.repeat(np.cumsum(f.windows) - f.windows, f.windows)
        begin, end = f.own.slices(start, start + self.length - 1)
        return which, [xxhash.xxh3_128_digest(f.own.data[x:y]) for x, y in zip(begin, end, strict=True)]


@dataclass
class _Found:
    own: Units
    at: np.ndarray
    g: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    doc: np.ndarray
    ids: np.ndarray


def copies_of(row: dict) -> np.ndarray:
    """Documents of a chunk whose whole text an earlier document has."""
    first = [NO_ID if x is None else x for x in row["leasts"]]
    for e in row["earlier"] or []:
        first[e["kind"]] = min(first[e["kind"]], e["first"])
    return np.array([i is not None and i > first[kind] for i, kind in zip(row["ids"], row["kinds"], strict=True)], bool)


def _send_contexts(seek: _Seek) -> Callable:
    """Distinct surroundings of surviving anchors, with the least id that has them here."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f, _ = seek.anchors(row)
                rows = []
                for bucket, seen in seek.contexts(f):
                    heads = np.array([i[0] for i in seen.values()])
                    lowest = np.array([f.ids[i].min() if len(i) > 1 else f.ids[i[0]] for i in seen.values()], np.int64)
                    rows.append((bucket, row["chunk"], packed(
                        np.array([len(c) for c, _ in seen], "<u4"), np.array([x for _, x in seen], "<u2"), f.windows[heads].astype("<u2"), lowest, b"".join(c for c, _ in seen), level=3,
                    )))
                yield _rows(rows, ["bucket", "chunk", "data"])

    return each


def _answers(least: Least) -> Callable:
    """Per chunk: the surroundings of which another chunk has a window in an earlier document, with the least id of each window."""

    def each(group: pa.Table) -> pa.Table:
        texts: list[bytes] = []
        parts, chunks = [], group["chunk"].to_pylist()
        for data in group["data"]:
            sizes, anchor, windows, lowest, joined = unpacked(data.as_py(), "<u4", "<u2", "<u2", "<i8", None)
            ends = np.cumsum(sizes, dtype=np.int64).tolist()
            texts += [joined[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            parts.append((anchor, windows, lowest))
        anchor, windows, mine = (np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True))
        first = least(Surroundings(texts, anchor, windows, mine))  # NO_ID stands behind the last window
        rows, a = [], 0
        for chunk, part in zip(chunks, parts, strict=True):
            b = a + len(part[0])
            told = np.flatnonzero((first[a:b] < mine[a:b, None]).any(axis=1))
            if len(told):
                flat = first[a:b][told]
                flat = flat[np.arange(flat.shape[1])[None, :] < windows[a:b][told][:, None]]
                rows.append((chunk, group["bucket"][0].as_py(), packed(told.astype("<u4"), flat)))
            a = b
        return pa.Table.from_batches([_rows(rows, ["chunk", "bucket", "data"])])

    return each


def _send_windows(seek: _Seek) -> Callable:
    """Each window of hot anchors once, with the least id that has it here."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lowest = _lowest(*seek.digests(f := seek.anchors(row)[1]), f.ids)
                yield _rows([(row["chunk"], d, i) for d, i in lowest.items()], ["chunk", "digest", "id"])

    return each


def _lowest(which: np.ndarray, digests: list[bytes], ids: np.ndarray) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for d, i in zip(digests, ids[which].tolist(), strict=True):
        if i < out.get(d, NO_ID):
            out[d] = i
    return out


def _cut_out(id_col: str, seek: _Seek) -> Callable:
    """Cuts the runs of units that an earlier document has out of a chunk's documents."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f, hot = seek.anchors(row)
                own, n = f.own, np.diff(f.own.begins)
                gone = np.zeros(len(own.tokens) + 1, np.int64)

                def cut(start: np.ndarray, windows: np.ndarray) -> None:
                    np.add.at(gone, start, 1)  # noqa: B023
                    np.add.at(gone, start + windows + seek.length - 1, -1)  # noqa: B023

                for start, windows in _earlier_here(row, seek, f):
                    cut(start, windows)
                if len(hot.at):
                    which, digests = seek.digests(hot)
                    lowest = _lowest(which, digests, hot.ids)
                    for w in row["windows"] or []:
                        lowest[bytes(w["digest"])] = w["first"]
                    start = hot.first[which] + np.arange(len(which)) - np.repeat(np.cumsum(hot.windows) - hot.windows, hot.windows)
                    start = start[np.array([lowest[d] for d in digests], np.int64) < hot.ids[which]]
                    cut(start, np.ones(len(start), np.int64))
                gone = np.cumsum(gone[:-1]) > 0
                for d in np.flatnonzero(copies_of(row)).tolist():
                    if n[d] >= seek.length:
                        gone[own.begins[d] : own.begins[d + 1]] = True
                out = [_left(own, d, gone[own.begins[d] : own.begins[d + 1]]) for d in range(len(n))]
                run = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                columns = [(row["ids"], pa.int64()), (n, pa.int64()), ([x[0] for x in out], pa.int64()), ([x[1] for x in out], run), ([x[2] for x in out], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=[id_col, "n_units", "n_removed", "runs", "kept"])

    return each


def _earlier_here(row: dict, seek: _Seek, f: _Found) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first windows, numbers of windows) of runs of windows that an earlier document has."""
    back = {b["bucket"]: b["data"] for b in row["back"] or []}
    for bucket, seen in seek.contexts(f):
        told, flat = unpacked(back[bucket], "<u4", "<i8") if bucket in back else (np.empty(0, np.int64), np.empty(0, np.int64))
        lists = list(seen.values())
        if not len(told) and all(len(i) == 1 for i in lists):
            continue
        which = np.repeat(np.arange(len(lists)), [len(i) for i in lists])
        occ = np.array([i for own in lists for i in own])
        lowest = np.minimum.reduceat(f.ids[occ], np.flatnonzero(np.r_[True, which[1:] != which[:-1]]))
        answer = np.full(len(lists), -1)
        answer[told] = np.arange(len(told))
        own = (answer[which] < 0) & (f.ids[occ] > lowest[which])
        yield f.first[occ[own]], f.windows[occ[own]]
        if not len(told):
            continue
        sizes = f.windows[[lists[t][0] for t in told.tolist()]]
        first = np.full((len(told), int(sizes.max())), NO_ID, np.int64)
        first[np.arange(first.shape[1])[None, :] < sizes[:, None]] = flat
        asked = np.flatnonzero(answer[which] >= 0)
        for s in range(0, len(asked), PART):
            i = asked[s : s + PART]
            step = np.diff(np.pad(first[answer[which[i]]] < f.ids[occ[i], None], ((0, 0), (1, 1))).astype(np.int8), axis=1)
            at, begin = np.nonzero(step == 1)
            yield f.first[occ[i[at]]] + begin, np.nonzero(step == -1)[1] - begin


def _left(own: Units, d: int, gone: np.ndarray) -> tuple[int, list[dict], bytes]:
    """Removed units, runs of them, and the bytes left of a document."""
    a, b = int(own.begins[d]), int(own.begins[d + 1])
    step = np.flatnonzero(np.diff(np.pad(gone, 1).astype(np.int8)))
    runs = step.reshape(-1, 2).tolist()
    bounds = [0, *step.tolist(), b - a]
    if own.places is None:
        kept = b"".join(own.data[a + x : a + y] for x, y in zip(bounds[::2], bounds[1::2], strict=True))
    else:
        kept = b" ".join(own.data[own.places[a + x] : own.ends[a + y - 1]] for x, y in zip(bounds[::2], bounds[1::2], strict=True) if y > x)
    return int(gone.sum()), [{"begin": x, "end": y} for x, y in runs], kept

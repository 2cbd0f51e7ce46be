"""Benchmark decontamination by Wu-Manber multi-pattern search.

A test item's windows of consecutive words are the patterns. Documents and items are brought to one
form (lower case A-Z, words joined by one space), so that a run of equal words is a run of equal
bytes. Patterns are put in classes by length; each class has a shift table over hashed blocks of
bytes, a suffix-hash bucket list, and a direct comparison of bytes. Many cursors walk over a batch
of documents at once, each skipping by its own shift.

Nulls and repeats: a null or word-less text has no words and no hits; an item without an id or
without words is ignored; repeated documents give one row each; repeated items count once per id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, packed_up, stored, unpacked_as, with_columns

#: Bytes of item text whose patterns are broadcast at once; more items go in further blocks.
BLOCK_BYTES = 8 << 20
#: Bytes of normalised document text searched at once.
BATCH_BYTES = 4 << 20
LANE = 2048
#: Bits of a shift table for few patterns, and at most; between, by the number of patterns and their blocks.
TABLE_BITS, MOST_TABLE_BITS = 18, 22
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SCAN_DDL = "n_words long, runs array<struct<start:long,end:long>>, items array<string>"
_TO_SPACE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def normalised(text: bytes) -> list[bytes]:
    """The words of a text, lower-cased."""
    return text.translate(_TO_SPACE).split()


def _block_hash(block: np.ndarray, bits: int) -> np.ndarray:
    return ((block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class _Class:
    """Wu-Manber tables for patterns of at least m bytes."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = min(8, max(1, self.m // 2))
        self.mask = np.uint64(0xFFFFFFFFFFFFFFFF >> (64 - 8 * self.block))
        wanted = len(patterns) * (self.m - self.block + 1) * 4
        self.bits = min(MOST_TABLE_BITS, max(TABLE_BITS, wanted.bit_length()))
        shift = np.full(1 << self.bits, self.m - self.block + 1, np.int16 if self.m < 1 << 15 else np.int32)
        heads = np.frombuffer(b"".join(p[: self.m] + bytes(8) for p in patterns), np.uint8)
        heads = heads.reshape(len(patterns), self.m + 8)
        for at in range(self.m - self.block + 1):
            h = _block_hash(np.ascontiguousarray(heads[:, at : at + 8]).view("<u8")[:, 0] & self.mask, self.bits)
            np.minimum.at(shift, h, self.m - self.block - at)
        self.shift = shift
        order = np.argsort(h, kind="stable")  # h: of the last block, by which the buckets go
        self.order, self.keys = order, h[order]

    def find(self, data: np.ndarray, blocks: np.ndarray, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, pattern number) of every occurrence in data[:end]; blocks: eight bytes at each place."""
        starts = np.arange(0, max(end - self.m + 1, 0), LANE)
        at, stop = starts.copy(), np.minimum(starts + LANE, end - self.m + 1)
        raw = data.tobytes()
        while len(at):
            h = _block_hash(blocks[at + (self.m - self.block)] & self.mask, self.bits)
            step = self.shift[h]
            if (hit := np.flatnonzero(step == 0)).size:
                lo, hi = np.searchsorted(self.keys, h[hit], "left"), np.searchsorted(self.keys, h[hit], "right")
                n = hi - lo
                where = np.repeat(at[hit], n)
                which = self.order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                same = [raw.startswith(self.patterns[k], p) for p, k in zip(where.tolist(), which.tolist(), strict=True)]
                if any(same):
                    yield where[same], which[same]
                step = np.maximum(step, 1)
            at = at + step
            on = at < stop
            at, stop = at[on], stop[on]


class WuManber:
    """Patterns are byte strings; those within a factor of two in length share a class."""

    def __init__(self, patterns: list[bytes]):
        by: dict[int, list[int]] = {}
        for k, p in enumerate(patterns):
            by.setdefault(len(p).bit_length(), []).append(k)
        self.classes = [(_Class([patterns[k] for k in ks]), np.array(ks)) for _, ks in sorted(by.items())]

    def find(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        padded = np.frombuffer(data + bytes(8), np.uint8)
        blocks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
        found = [(at, ks[which]) for c, ks in self.classes for at, which in c.find(padded, blocks, len(data))]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, ngram: int) -> DataFrame:
    """One row per item and distinct window (words joined by a space)."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"({_WORD})"))
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words.alias("w"))
    items = items.where(F.col("item").isNotNull() & (F.size("w") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (ngram - 1)))
    windows = items.select("item", "w", F.explode(starts).alias("i"))
    return windows.select("item", F.array_join(F.slice("w", F.col("i"), ngram), " ").alias("window")).distinct()


def _scan(docs: DataFrame, text_col: str, windows: list[tuple[str, list[str]]]) -> DataFrame:
    """Adds n_words, runs (hit words, [start, end) by word) and items to docs."""
    patterns = docs.sparkSession.sparkContext.broadcast(windows)

    def make():
        items = [x for _, x in patterns.value]
        matcher = WuManber([f" {w} ".encode() for w, _ in patterns.value])

        def search(texts: list[bytes]):
            found: list[tuple] = []
            part: list[bytes] = []
            counts: list[int] = []
            held = 0
            for text in texts:
                words = normalised(text)
                part.append(b" ".join([b"", *words, b""]) if words else b" ")
                counts.append(len(words))
                held += len(part[-1])
                if held >= BATCH_BYTES:
                    found += _hits(matcher, items, part, counts)
                    part, counts, held = [], [], 0
            found += _hits(matcher, items, part, counts)
            return zip(*found, strict=True) if found else ([], [], [])

        return search

    run = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return with_columns(docs, text_col, _SCAN_DDL, [pa.int64(), pa.list_(run), pa.list_(pa.string())], make)


def _hits(matcher: WuManber, items: list[list[str]], texts: list[bytes], counts: list[int]):
    """Of each text: number of words, merged runs of hit words, items."""
    data = b"\n".join(texts)  # no pattern holds a line break, so none crosses texts
    at, which = matcher.find(data)
    out = [(n, [], []) for n in counts]
    if not len(at):
        return out
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    order = np.argsort(at, kind="stable")
    at, which = at[order], which[order]
    doc = np.searchsorted(begin, at, "right") - 1
    for d in np.unique(doc).tolist():
        mine = slice(*np.searchsorted(doc, [d, d + 1]))
        spaces = np.flatnonzero(np.frombuffer(texts[d], np.uint8) == 32)
        first = np.searchsorted(spaces, at[mine] - begin[d])
        runs: list[list[int]] = []
        names: set[str] = set()
        lengths = [matcher_words(matcher, k) for k in which[mine].tolist()]
        for start, n, k in zip(first.tolist(), lengths, which[mine].tolist(), strict=True):
            names.update(items[k])
            if runs and start <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], start + n)
            else:
                runs.append([start, start + n])
        out[d] = (counts[d], [{"start": a, "end": b} for a, b in runs], sorted(names))
    return out


def matcher_words(matcher: WuManber, pattern: int) -> int:
    """Words in a pattern: the spaces between and around them, less one."""
    if not hasattr(matcher, "words"):
        matcher.words = {k: p.count(b" ") - 1 for c, ks in matcher.classes for k, p in zip(ks.tolist(), c.patterns, strict=True)}
    return matcher.words[pattern]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", ngram: int = 10, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Adds n_words, runs of words that occur in a window of a test item, n_hit and the items found.

    The windows are the query set: they are dealt by hash into blocks of about block_bytes, each collected,
    broadcast and searched in all documents on its own. With one block documents are not shuffled at all.
    Columns of docs called n_words, runs, items or n_hit are replaced; others pass through, whatever their names.
    """
    docs = docs.drop("n_words", "runs", "items", "n_hit")
    rows = packed_up(docs, text_col)
    windows = item_windows(benchmark, item_id_col, item_text_col, ngram)
    grouped = windows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    grouped = stored(grouped, "windows")
    size = F.length("window") * 4 + 64 + F.aggregate("items", F.lit(0), lambda n, i: n + F.length(i))
    blocks = -(-(grouped.agg(F.sum(size)).head()[0] or 0) // block_bytes)
    block = lambda b: [(r.window, list(r["items"])) for r in grouped.where(F.pmod(F.xxhash64("window"), F.lit(max(blocks, 1))) == b).collect()]
    if blocks <= 1:
        found = _scan(rows, "_text", block(0))
    else:
        key = [F.col("_doc")[id_col].alias("_id"), F.sha2(F.coalesce("_text", F.lit("")), 256).alias("_key")]
        small = rows.select(*key, "_text")
        # one block after the other: the driver holds the windows of one at a time
        hits = [stored(_scan(small, "_text", block(b)).where("size(runs) > 0").select("_id", "_key", "runs", "items"), "hits") for b in range(blocks)]
        every = hits[0]
        for more in hits[1:]:
            every = every.unionByName(more)
        merged = every.groupBy("_id", "_key").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        ).withColumn("runs", _merged(F.col("runs")))
        words = F.size(F.regexp_extract_all(ascii_lower(F.coalesce("_text", F.lit(""))), F.lit(f"({_WORD})")))
        left = rows.withColumns({"_id2": key[0], "_key2": key[1], "n_words": words.cast("long")})
        found = left.join(merged, F.col("_id2").eqNullSafe(F.col("_id")) & (F.col("_key2") == F.col("_key")), "left")
        found = found.select("_doc", "_text", "n_words", F.coalesce("runs", F.array().cast("array<struct<start:long,end:long>>")).alias("runs"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select(*unpacked_as(docs, text_col), "n_words", "runs", "items", n_hit.alias("n_hit"))


def _merged(runs):
    """Sorted runs without overlaps."""
    empty = F.array().cast("array<struct<start:long,end:long>>")

    def add(done, r):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (r["start"] <= F.try_element_at(done, F.lit(-1))["end"]),
                      F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(runs, empty, add)

"""Packing of tokenised documents by bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document's full windows are cut off first;
the rest goes into the open window that it fills best. When none fits, the fullest is emitted, its
gap filled with the front of the rest, so nothing is padded. At the end the leftover windows are
merged into full ones; the last tokens become sequences whose lengths are powers of two, which
need no padding either. Nothing is shuffled and no partition needs more memory than its windows.

Nulls and repeats: a null text is empty and is packed as the end token alone; repeated rows are
packed each on their own; a null id is kept. Sequence ids are the partition's number times 2^33
plus a counter, so a lost task repeats with the same ids. Very long texts, words and runs of white
space are encoded in full. Only the id (of any type) and the text are read: other columns of docs,
whatever their names, are not in the pieces, which carry the id to join by.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import extended, slices

LENGTH = 1024
WINDOWS = 32
#: Fixed: the pre-tokenisation pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: White space of the pattern, spelt out: other notions of white space differ by a few characters.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The fast matcher runs out of stack in white space of about a million characters; runs from here on go another way.
LONG_RUN = 1 << 16
_RUN = re.compile(f"[{_WHITE}]{{{LONG_RUN},}}")
#: Where no pre-token goes on: between another character and white space. Long texts are encoded in such parts.
_CUT = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")
PART_CHARS = 1 << 20


def _checked(model: dict) -> dict[str, int]:
    """The added tokens of a vocabulary file; an error for a setting that the encoder below does not follow."""
    bpe, before, added = model["model"], model.get("pre_tokenizer") or {}, model.get("added_tokens", [])
    if bpe.get("type", "BPE") != "BPE" or any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError("not a plain byte-level BPE model")
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model.get("normalizer"):
        raise ValueError("not the pre-tokenisation of byte-level BPE, or a normalizer")
    if any(x.get(flag) for x in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that take more or less than their own text")
    ids = [bpe["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in bpe["merges"]]
    if any(x >= y for x, y in zip(ids, ids[1:], strict=False)):
        raise ValueError("merges that are not ranked by id")
    return {x["content"]: x["id"] for x in added}


@lru_cache(maxsize=2)  # once per worker process, not per task
def _vocabulary(path: str, special: bool):
    """(tiktoken encoding, added tokens) of a vocabulary file."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    names = _checked(model)
    model["model"].pop("merges")
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in names}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=names if special else {}), names


def decoder(path: str) -> Callable[[np.ndarray], str]:
    """The text of ids that encoder(path) gave for a whole text."""
    fast, _ = _vocabulary(path, False)
    return lambda ids: fast.decode_bytes(ids.tolist()).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)  # once per worker process, not per task
def encoder(path: str, special: bool = False) -> Callable[[str], np.ndarray]:
    """Ids of a text under a byte-level BPE vocabulary file (tokenizers JSON), as the tokenizers library gives them.

    special: the file's added tokens get their ids where they stand in a text, as that library does
    unless told otherwise; without it they are ordinary text. The file's merges are ranked by id
    (checked), so the same ids come from the faster of the two public libraries. White space of
    LONG_RUN characters or more, a single pre-token but for its last character before a word, goes
    to the other one; tests hold both against each other.
    """
    import tokenizers

    fast, names = _vocabulary(path, special)
    whole = partial(fast.encode, allowed_special="all") if special else fast.encode_ordinary
    slow = lru_cache(maxsize=1)(lambda: tokenizers.Tokenizer.from_file(path))
    apart = re.compile("(" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + ")") if special and names else None

    def parts(text: str) -> Iterator[list[int]]:
        """Ids of a text without added tokens."""
        at = 0
        for run in [*_RUN.finditer(text), None]:
            begin = run.start() if run else len(text)
            while at < begin:
                cut = _CUT.search(text, at + PART_CHARS, begin) if begin - at > PART_CHARS else None
                stop = cut.start() if cut else begin
                yield fast.encode_ordinary(text[at:stop])
                at = stop
            if run:
                at = run.end() if run.end() == len(text) else run.end() - 1
                yield slow().encode(text[begin:at], add_special_tokens=False).ids

    def encode(text: str) -> np.ndarray:
        if len(text) < LONG_RUN:
            return np.array(whole(text), np.int32)
        pieces = apart.split(text) if apart else [text]
        done = [[names[p]] if k % 2 else parts(p) for k, p in enumerate(pieces)]
        return np.concatenate([np.array(ids, np.int32) for x in done for ids in ([x] if isinstance(x, list) else x)])

    return encode


class Packer:
    """Open windows of one partition; emits lists of pieces (document, start, ids), each list one sequence."""

    def __init__(self, length: int, windows: int):
        self.length, self.windows = length, windows
        self.open: list[list] = []
        self.room: list[int] = []

    def add(self, key, start: int, ids: np.ndarray) -> Iterator[list]:
        while len(ids) >= self.length:
            yield [(key, start, ids[: self.length])]
            start, ids = start + self.length, ids[self.length :]
        if not len(ids):
            return
        fits = [(r, i) for i, r in enumerate(self.room) if r >= len(ids)]
        if fits:
            i = min(fits)[1]
            self.open[i].append((key, start, ids))
            self.room[i] -= len(ids)
            if not self.room[i]:
                self.room.pop(i)
                yield self.open.pop(i)
            return
        if len(self.open) >= self.windows:
            i = min(range(len(self.room)), key=self.room.__getitem__)
            gap = self.room.pop(i)
            full = self.open.pop(i)
            full.append((key, start, ids[:gap]))
            yield full
            start, ids = start + gap, ids[gap:]
        self.open.append([(key, start, ids)])
        self.room.append(self.length - len(ids))

    def _size(self, left: int) -> int:
        """The window's length, or the largest power of two that the leftovers fill."""
        return min(self.length, 1 << max(left.bit_length() - 1, 0))

    def finish(self) -> Iterator[list]:
        """Merges the leftovers: fullest first, cut where a window is full."""
        order = sorted(range(len(self.open)), key=self.room.__getitem__)
        pieces = [p for i in order for p in self.open[i]]
        left = sum(len(p[2]) for p in pieces)
        self.open, self.room = [], []
        now: list = []
        size, held = self._size(left), 0
        while pieces:
            key, start, ids = pieces.pop(0)
            take = ids[: size - held]
            now.append((key, start, take))
            held += len(take)
            left -= len(take)
            if len(take) < len(ids):
                pieces.insert(0, (key, start + len(take), ids[len(take) :]))
            if held == size:
                yield now
                now, held = [], 0
                size = self._size(left)


def pack(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, length: int = LENGTH, windows: int = WINDOWS,
    special: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids, doc_tokens, sequence_id, offset. Sequences are full or a power of two long.

    special: added tokens of the vocabulary file that stand in a text get their own ids.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    kind = docs.schema[id_col]
    schema = extended(StructType([kind]), "start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, special)
        packer = Packer(length, windows)
        number = TaskContext.get().partitionId() << 33
        columns: list[list] = [[] for _ in range(7)]

        def out(sequence: list) -> None:
            nonlocal number
            at = 0
            for (doc, total), start, ids in sequence:
                for column, value in zip(columns, (doc, start, len(ids), ids, total, number, at), strict=True):
                    column.append(value)
                at += len(ids)
            number += 1

        def batch_of(kind: pa.DataType) -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)
            for column in columns:
                column.clear()
            return made

        kind = None
        for batch in slices(batches):
            kind = batch.schema.types[0]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.int32(end_id))
                for sequence in packer.add((doc, len(ids)), 0, ids):
                    out(sequence)
                if len(columns[0]) >= 2000:
                    yield batch_of(kind)
        for sequence in packer.finish():
            out(sequence)
        if kind is not None and columns[0]:
            yield batch_of(kind)
        pa.default_memory_pool().release_unused()

    return docs.select(id_col, text_col).mapInArrow(each, schema)


def with_crc(pieces: DataFrame) -> DataFrame:
    """Replaces ids by ids_crc32: the checksum of the ids as little-endian unsigned 32-bit numbers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("ids")
            lists = batch.column(k)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            crc = pa.array([zlib.crc32(x.tobytes()) for x in np.split(flat, ends[:-1])] if len(ends) else [], pa.int64())
            yield batch.set_column(k, "ids_crc32", crc)

    fields = ["ids_crc32 long" if f.name == "ids" else f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
    return pieces.mapInArrow(each, ", ".join(fields))

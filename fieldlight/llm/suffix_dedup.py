"""Suffix-array deduplication of byte strings.

The suffixes at content-chosen anchors (see repeats) are range-partitioned by their leading bytes;
splitters come from a sample of leading bytes that every chunk gives, by approximate percentiles.
A bucket sorts its suffixes by multikey quicksort, and the bytes before the anchors, reversed, in
the same way. Neighbours' common prefixes of both orders split the suffixes into classes at any
depth, so that a window (so many bytes before the anchor, the rest after) is a pair of classes, and
equal windows are found exactly, without comparing hashes. Splitters fall between different
leading bytes; the suffixes on the two sides of a boundary differ there, so no match crosses it.

Null texts are empty; texts shorter than a window keep all; repeated rows with the same id are not
earlier than each other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import NO_ID, Surroundings, byte_units, repeats

LENGTH = 50
K = 16


def multikey_sort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first key that differs from the row before) of the rows of keys, a (rows, words) matrix.

    Multikey quicksort over an alphabet of machine words: all groups are partitioned by their word
    at one depth together; only rows that are equal so far go on to the next.
    """
    n, depth = keys.shape
    order = np.argsort(keys[:, 0], kind="stable")
    differs = np.full(n, depth, np.int64)
    word = keys[order, 0]
    differs[np.flatnonzero(np.r_[True, word[1:] != word[:-1]])[: n or None]] = 0
    for d in range(1, depth):
        head = differs < d
        equal = ~head
        open_ = np.flatnonzero(equal | np.r_[equal[1:], False])  # rows of groups of two or more
        if not len(open_):
            break
        group = np.cumsum(head)[open_]
        rows = order[open_]
        by = np.lexsort((keys[rows, d], group))
        rows = rows[by]
        order[open_] = rows
        word = keys[rows, d]
        new = np.r_[True, (word[1:] != word[:-1])] & ~np.r_[True, group[1:] != group[:-1]]
        differs[open_[new]] = d
    return order, differs


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    """Rows of bytes, padded with zeros to whole words."""
    wide = -(-width // 8) * 8
    return np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in parts), np.uint8).reshape(-1, wide)


def _classes(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the row before) of byte strings, the shorter first among equals."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = _matrix(parts, width)
    keys = np.concatenate([raw.view(">u8").astype(np.uint64), sizes[:, None].astype(np.uint64)], axis=1)
    order, _ = multikey_sort(keys)
    raw, sizes = raw[order], sizes[order]
    apart = raw[1:] != raw[:-1]
    same = np.where(apart.any(axis=1), apart.argmax(axis=1), raw.shape[1]) if len(parts) > 1 else np.empty(0, np.int64)
    return order, np.r_[0, np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))]


def least_by_suffixes(length: int):
    """For repeats(): the least id of each window, by classes of suffixes and of reversed prefixes."""

    def least(s: Surroundings) -> np.ndarray:
        n, most = len(s.texts), int(s.windows.max())
        cut = s.anchor.tolist()
        right = _classes([t[a : a + length] for t, a in zip(s.texts, cut, strict=True)], length)
        left = _classes([t[:a][::-1] for t, a in zip(s.texts, cut, strict=True)], int(s.anchor.max()) or 1)
        out = np.full((n, most), NO_ID, np.int64)
        for before in range(int(s.anchor.max()) + 1):
            own = np.flatnonzero((s.anchor >= before) & (s.anchor - before < s.windows))
            if not len(own):
                continue
            key = _at(right, length - before)[own] * np.int64(n + 1) + _at(left, before)[own]
            order = np.argsort(key, kind="stable")
            key, ids = key[order], s.ids[own[order]]
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            low = np.repeat(np.minimum.reduceat(ids, heads), np.diff(np.r_[heads, len(key)]))
            out[own[order], s.anchor[own[order]] - before] = low
        return out

    return least


def _at(classes: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    """Number of each row's class of rows that agree in their first depth bytes."""
    order, common = classes
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """(id, n_units, n_removed, runs, kept) by bytes: bytes that a document with a smaller id has go."""
    return repeats(docs, id_col=id_col, text_col=text_col, length=length, k=k, units=byte_units, least=least_by_suffixes(length), by_range=True)

"""Substring deduplication by suffix automata of reference shards.

Shards are the surroundings of anchors (see repeats) that share a range of anchor hashes. A task
builds the suffix automaton of its shard's distinct word sequences, with the least document id of
each state, and streams every sequence through it: the matching statistics give, at each word, the
state of the last `length` words, and so the least document that has them. Maximal spans with an
earlier document are cut out of the documents.

Every document is both reference and stream. Sending every automaton to every document would cost
documents times shards; equal windows have equal anchors, so a sequence is streamed only through
the one shard that can match it, and the automaton stays in the task that built it.

Null texts have no words; texts shorter than a window keep all; repeated rows with the same id are
not earlier than each other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import NO_ID, Surroundings, repeats, word_units

LENGTH = 13
K = 4


class Automaton:
    """A generalised suffix automaton over words, with the least id of every state."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.size: list[int] = [0]
        self.id: list[int] = [NO_ID]

    def _state(self, size: int, link: int, moves: dict) -> int:
        self.next.append(moves), self.link.append(link), self.size.append(size), self.id.append(NO_ID)
        return len(self.size) - 1

    def add(self, words: list[bytes], own: int) -> None:
        follow, link, size = self.next, self.link, self.size
        last = 0
        for w in words:
            q = follow[last].get(w)
            if q is not None:
                if size[q] == size[last] + 1:
                    last = q
                else:
                    last = self._clone(last, w, q)
            else:
                p, last = last, self._state(size[last] + 1, 0, {})
                while p >= 0 and w not in follow[p]:
                    follow[p][w] = last
                    p = link[p]
                if p >= 0:
                    q = follow[p][w]
                    link[last] = q if size[q] == size[p] + 1 else self._clone(p, w, q)
            if own < self.id[last]:
                self.id[last] = own

    def _clone(self, p: int, w: bytes, q: int) -> int:
        new = self._state(self.size[p] + 1, self.link[q], self.next[q].copy())
        self.id[new] = self.id[q]
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def finish(self) -> None:
        """Ids of longer contexts to their suffixes."""
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up = self.link[v]
            if self.id[v] < self.id[up]:
                self.id[up] = self.id[v]

    def statistics(self, words: list[bytes], length: int) -> list[int]:
        """For each place from length - 1 on: the least id that has the `length` words ending there."""
        state, matched, out = 0, 0, []
        follow, link, size = self.next, self.link, self.size
        for i, w in enumerate(words):
            while state and w not in follow[state]:
                state = link[state]
                matched = size[state]
            if w in follow[state]:
                state, matched = follow[state][w], matched + 1
            while size[link[state]] >= length:
                state = link[state]
                matched = size[state]
            if i >= length - 1:
                out.append(self.id[state] if matched >= length else NO_ID)
        return out


def least_by_automaton(length: int):
    """For repeats(): the least id of each window, by matching statistics over the shard's automaton."""

    def least(s: Surroundings) -> np.ndarray:
        ids: dict[bytes, int] = {}
        for text, own in zip(s.texts, s.ids.tolist(), strict=True):
            if own < ids.get(text, NO_ID):
                ids[text] = own
        shard = Automaton()
        split = {text: text.split() for text in ids}
        for text, own in ids.items():
            shard.add(split[text], own)
        shard.finish()
        found = {text: shard.statistics(words, length) for text, words in split.items()}
        most = int(s.windows.max())
        out = np.full((len(s.texts), most), NO_ID, np.int64)
        rows = [found[t] for t in s.texts]
        flat = np.array([x for row in rows for x in row], np.int64)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        out[np.arange(most)[None, :] < sizes[:, None]] = flat
        return out

    return least


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """(id, n_units, n_removed, runs, kept) by words: words that a document with a smaller id has go."""
    return repeats(docs, id_col=id_col, text_col=text_col, length=length, k=k, units=word_units, least=least_by_automaton(length), by_range=False)

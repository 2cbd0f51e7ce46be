"""Chat formatting into shared-prefix trees of tokens.

Conversations are sorted by their turns, so that those with the same first turns lie side by side;
a range partition of that order is a run of a depth-first walk over the prefix tree of all of them.
Each partition walks its run: turns shared with the conversation before are not emitted again, so
a partition emits the tokens of a shared turn once, however long it is and however many share it.
Conversations with the same first turn are one tree. A tree is written in parts of bounded size,
which hold new nodes only: the tokens, and per node its place in the tree, its parent, the position
id of its first token in its own conversation (the others follow on), the tokens under the loss
mask, and the intervals of the tree's tokens that it may attend to besides itself (its ancestors).
A very common first turn is only a wide node: its conversations spread over many partitions, each of
which has a tree of its own with that turn once.

Template: "### role: text </turn>\\n", with backslashes doubled and both control strings escaped by
a backslash inside roles and texts; reading back is exact. The opening, the text and the end of a
turn are encoded apart, so that no token crosses them. Loss is on assistant texts.

Nulls and repeats: null roles and texts are empty; turns of a conversation go by turn, then role,
then text (null turns first); repeated rows are repeated turns; a null conv_id is a conversation.
conv_id must be an integer that fits a long. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import decoder, encoder

OPEN, CLOSE = "###", "</turn>"
#: New tokens of a tree after which its next part begins.
PART_TOKENS = 1 << 14
_SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
_NODE = pa.struct([
    ("node", pa.int64()), ("parent", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("position", pa.int64()),
    ("loss_begin", pa.int64()), ("loss_end", pa.int64()), ("attends", pa.list_(_SPAN)),
])
_MEMBER = pa.struct([("conv_id", pa.int64()), ("leaf", pa.int64())])
_TREE = {"tree": pa.int64(), "part": pa.int64(), "begin": pa.int64(), "ids": pa.list_(pa.int32()), "nodes": pa.list_(_NODE), "members": pa.list_(_MEMBER)}
TREE_DDL = (
    "tree long, part long, begin long, ids array<int>, nodes array<struct<node:long,parent:long,begin:long,end:long,position:long,"
    "loss_begin:long,loss_end:long,attends:array<struct<begin:long,end:long>>>>, members array<struct<conv_id:long,leaf:long>>"
)


_NEXT = re.compile(r"\\(?:\\|###|</turn>)| </turn>\n")


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace(OPEN, "\\" + OPEN).replace(CLOSE, "\\" + CLOSE)


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\|###|</turn>)", r"\1", text)


def head(role: str) -> str:
    """A turn's opening; colons of a role are escaped with their own mark."""
    return f"{OPEN} {escaped(role).replace(':', chr(92) + 'c')}: "


def turns_of(text: str) -> list[tuple[str, int, int]]:
    """(role, begin, end of its escaped text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN + " ", at):
            raise ValueError("a turn does not begin where the last one ended")
        begin = text.index(": ", at) + 2
        role = re.sub(r"\\(\\|###|</turn>|c)", lambda m: ":" if m[1] == "c" else m[1], text[at + 4 : begin - 2])
        mark = _NEXT.search(text, begin)
        while mark[0][0] == "\\":
            mark = _NEXT.search(text, mark.end())
        end = mark.start()
        out.append((role, begin, end))
        at = end + len(CLOSE) + 2
    return out


class _Walk:
    """The open path of a depth-first walk, and the part that is being filled."""

    def __init__(self, encode, first_tree: int, part_tokens: int):
        self.encode, self.heads = encode, lru_cache(maxsize=64)(lambda role: encode(head(role)))
        self.close = encode(f" {CLOSE}\n")
        self.tree, self.most = first_tree - 1, part_tokens
        self.path: list[tuple[tuple[str, str], dict]] = []
        self.node = self.part = self.size = self.begin = 0
        self.ids: list[np.ndarray] = []
        self.nodes: list[dict] = []
        self.members: list[dict] = []

    def flush(self) -> Iterator[tuple]:
        """The part so far as a row, if it has anything."""
        if self.members or self.nodes:
            yield self.tree, self.part, self.begin, np.concatenate(self.ids or [self.close[:0]]), self.nodes, self.members
            self.part, self.begin, self.ids, self.nodes, self.members = self.part + 1, self.size, [], [], []

    def add(self, conv_id, turns: list[tuple[str, str]]) -> Iterator[tuple]:
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        if not shared:
            yield from self.flush()
            self.tree += 1
            self.node = self.part = self.size = self.begin = 0
        for turn in turns[shared:]:
            self._emit(*turn)
        self.members.append({"conv_id": conv_id, "leaf": self.path[-1][1]["node"]})
        if self.size - self.begin >= self.most:
            yield from self.flush()

    def _emit(self, role: str, text: str) -> None:
        up = self.path[-1][1] if self.path else None
        before, body = self.heads(role), self.encode(escaped(text))
        own = {"begin": self.size, "end": self.size + len(before) + len(body) + len(self.close)}
        loss = (self.size + len(before), own["end"] - len(self.close)) if role == "assistant" else (None, None)
        attends = _joined([*up["attends"], {"begin": up["begin"], "end": up["end"]}]) if up else []
        position = up["position"] + up["end"] - up["begin"] if up else 0
        node = {"node": self.node, "parent": up and up["node"], **own, "position": position, "loss_begin": loss[0], "loss_end": loss[1], "attends": attends}
        self.nodes.append(node)
        self.path.append(((role, text), node))
        self.ids += [before, body, self.close]
        self.size, self.node = own["end"], self.node + 1


def _joined(spans: list[dict]) -> list[dict]:
    """Sorted intervals, touching ones as one."""
    out: list[dict] = []
    for s in spans:
        if out and out[-1]["end"] == s["begin"]:
            out[-1] = {"begin": out[-1]["begin"], "end": s["end"]}
        else:
            out.append(s)
    return out


def chat_trees(conversations: DataFrame, tokenizer_path: str, *, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Rows of conv_id, turn, role, text become parts of trees: ids, nodes and members (conv_id and leaf node).

    A tree's parts are rows that follow each other in one partition.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = whole.select(F.col("conv_id").cast("long").alias("conv_id"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    # the order of a depth-first walk: by digests of turns, then by id, so that equal conversations spread too
    path = F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))
    walk = whole.withColumn("path", path).repartitionByRange(F.col("path"), F.col("conv_id")).sortWithinPartitions("path", "conv_id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(encoder(tokenizer_path), TaskContext.get().partitionId() << 33, part_tokens)
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in walk.add(conv_id, [(t["role"], t["text"]) for t in turns]):
                    rows.append(row)
                    held += len(row[3])
                if held >= part_tokens:
                    yield _batch(rows)
                    rows, held = [], 0
        rows += walk.flush()
        if rows:
            yield _batch(rows)

    return walk.select("conv_id", "turns").mapInArrow(each, TREE_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TREE.values(), strict=True)], names=list(_TREE))


READ_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(trees: DataFrame, tokenizer_path: str, *, in_order: bool = False) -> DataFrame:
    """Per conversation, from the parts alone: turns, loss text and length, as counts and digests.

    in_order: trees is what chat_trees returned, not yet dealt anew; otherwise parts are brought
    together by tree. Only the tokens of the open path are held.
    """
    if not in_order:
        trees = trees.repartition("tree").sortWithinPartitions("tree", "part")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(tokenizer_path)
        tree, path = None, []
        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).drop_columns("ids").to_pylist()[0]
                ids = batch.column("ids")[k].values.to_numpy()
                if row["tree"] != tree:
                    tree, path = row["tree"], []
                nodes = iter(row["nodes"])
                for member in row["members"]:
                    while path and path[-1][0]["node"] > member["leaf"]:
                        path.pop()
                    while not path or path[-1][0]["node"] != member["leaf"]:
                        node = next(nodes)
                        while path and path[-1][0]["node"] != node["parent"]:
                            path.pop()
                        path.append((node, ids[node["begin"] - row["begin"] : node["end"] - row["begin"]]))
                    out.append((member["conv_id"], *digest_of(path, decode)))
            if out:
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return trees.select(*_TREE).mapInArrow(each, READ_DDL)


def digest_of(path: list[tuple[dict, np.ndarray]], decode) -> tuple:
    """Of a conversation, whose own tokens are those of its leaf's path: what the leaf attends to, then the leaf."""
    leaf = path[-1][0]
    if _joined([{"begin": n["begin"], "end": n["end"]} for n, _ in path[:-1]]) != leaf["attends"]:
        raise ValueError("the leaf does not attend to its ancestors")
    own = decode(np.concatenate([ids for _, ids in path]))
    masked = [ids[n["loss_begin"] - n["begin"] : n["loss_end"] - n["begin"]] for n, ids in path if n["loss_begin"] is not None]
    loss = "".join(unescaped(decode(x)) for x in masked)
    turns = [(role, unescaped(own[a:b])) for role, a, b in turns_of(own)]
    said = "".join(f"{role}\n{t}\n" for role, t in turns)
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    return len(turns), sha(said), len(loss), sha(loss), len(own)

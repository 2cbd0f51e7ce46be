"""SimHash near-duplicates by pivot distance tables.

1. A fingerprint of each text: the majority bit of the hashes of its word shingles.
2. Distinct fingerprints only, each with its least document id; copies never meet each other again.
3. A table of Hamming distances of each fingerprint to many reference fingerprints: a base, the base
   with one bit turned, for every bit, and a few spread ones. Coordinates of two fingerprints within
   d bits differ by at most d. The step from the base's coordinate to a turned one's is +1 or -1, and
   within d bits at most d steps differ. So the join keys are the steps at chosen references. For a
   small limit the choices are all but `limit` of some segments, which no pair within the limit
   escapes (pigeonhole); for a wide one they are random, as many as the stated recall needs.
4. Within a key, pairs are discarded by the largest difference of their coordinates to the spread
   references, which come with them; survivors are verified by exact Hamming distance. Only edges
   that join two groups are emitted.
5. Keys with very many fingerprints: all are first compared with a few hubs of the key. Those joined
   to the most common hub need no comparison among each other; the rest meets all, in salted blocks,
   each its own group.
6. Connected components over the edges, by document id.

Nulls and ties: null or word-less texts have fingerprint zero and are linked like any other; repeated
rows share a component; an id that has several texts does not link them; a null id is kept as a row with
its fingerprint and gets the least non-null id of its component (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import acos, ceil, comb, log, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, with_columns
from .components import components

#: Fingerprints with one key beyond which the key is hot.
BLOCK = 4096
#: References whose coordinates discard pairs inside a key, and hubs of a hot key.
SPREAD, HUBS = 8, 8
#: Limits up to which keys are segments that lose no pair.
EXACT_LIMIT = 6
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of the word shingles of a text; fewer words than the width are one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_ODD[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_ODD[2])
    return x ^ (x >> np.uint64(31))


def fingerprint_words(text: bytes, width: int, words: int, distinct: bool) -> np.ndarray:
    """64 bits a word; the first word is by the shingles' XXH64, more by numbers derived from it."""
    hashes = shingle_hashes(text, width)
    return words_of(np.unique(hashes) if distinct else hashes, words)


def words_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """The fingerprint of shingle hashes."""
    out = np.zeros(words, np.uint64)
    for w in range(words if len(hashes) else 0):
        own = _mixed(hashes + np.uint64(w * _ODD[0] & 0xFFFFFFFFFFFFFFFF)) if w else hashes
        ones = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * ones > len(own), bitorder="little").view("<u8")[0]
    return out


def fingerprint(text: bytes, width: int = 4) -> int:
    """The 64-bit SimHash of the shingles of a text, repeats included; 0 without words."""
    return int(fingerprint_words(text, width, 1, False)[0])


def with_fingerprints(docs: DataFrame, *, text_col: str = "text", width: int = 4, bits: int = 64, distinct: bool = False) -> DataFrame:
    """Adds, or replaces, column fp: an array of signed longs of 64 bits each."""
    words = bits // 64
    return with_columns(
        docs, text_col, "fp array<long>", [pa.list_(pa.int64())],
        lambda: lambda texts: [[fingerprint_words(t, width, words, distinct).view(np.int64) for t in texts]],
    )


def limit_of(similarity: float, bits: int) -> int:
    """Bits in which fingerprints of two shingle sets of that Jaccard similarity differ, on average."""
    return ceil(bits * acos(2 * similarity / (1 + similarity)) / pi)


@dataclass(frozen=True)
class Pivots:
    """References (the base, turned ones, spread ones), and the steps that make each key."""

    references: np.ndarray  # (1 + bits + SPREAD, words)
    masks: np.ndarray  # (keys, words): the chosen steps as bits
    limit: int

    def table(self, fps: np.ndarray) -> np.ndarray:
        """Hamming distance of each fingerprint (words as columns) to each reference."""
        out = np.zeros((len(fps), len(self.references)), np.int16)
        for w in range(fps.shape[1]):
            out += np.bitwise_count(fps[:, w, None] ^ self.references[None, :, w])
        return out

    def keys(self, table: np.ndarray) -> np.ndarray:
        """A number for each choice of steps."""
        turned = np.packbits(table[:, 1:-SPREAD] < table[:, :1], axis=1, bitorder="little").view("<u8")
        out = np.empty((len(table), len(self.masks)), np.uint64)
        for k, mask in enumerate(self.masks):
            key = np.full(len(table), k * _ODD[1] & 0xFFFFFFFFFFFFFFFF, np.uint64)
            for w, m in enumerate(mask):
                if m:
                    key = _mixed((key ^ (turned[:, w] & m)) * np.uint64(_ODD[0]))
            out[:, k] = key
        return out


def segment_masks(n: int, bits: int, limit: int) -> list[int]:
    """All choices of all but `limit` segments: more and so longer keys as the number of fingerprints grows."""
    def sizes(k: int) -> list[int]:
        return [bits // k + (i < bits % k) for i in range(k)]

    k = limit + 2
    while k < 16 and n > 4 * 2 ** sum(sorted(sizes(k))[: k - limit]):
        k += 1
    ends = np.cumsum([0, *sizes(k)]).tolist()
    segments = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(segments, k - limit)]


def random_masks(n: int, bits: int, limit: int, recall: float) -> list[int]:
    """Random choices, of about log2 n steps each, of which a pair at the limit shares one with probability `recall`."""
    b = max(8, ceil(log2(max(n, 2))) - 2)
    hit = comb(bits - limit, b) / comb(bits, b)
    dice = np.random.default_rng(17)
    return [sum(1 << int(i) for i in dice.choice(bits, b, replace=False)) for _ in range(ceil(log(1 - recall) / log(1 - hit)))]


def pivots(n: int, bits: int, limit: int, recall: float, usual: int | None = None) -> Pivots:
    dice = np.random.default_rng(7)
    base, *spread = ([int(x) for x in dice.integers(0, 2**64, bits // 64, np.uint64)] for _ in range(1 + SPREAD))
    turned = [[x ^ (1 << i % 64 if w == i // 64 else 0) for w, x in enumerate(base)] for i in range(bits)]
    masks = segment_masks(n, bits, limit) if limit <= EXACT_LIMIT else random_masks(n, bits, usual or limit, recall)
    parted = [[m >> 64 * w & 0xFFFFFFFFFFFFFFFF for w in range(bits // 64)] for m in masks]
    return Pivots(np.array([base, *turned, *spread], np.uint64), np.array(parted, np.uint64), limit)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _links(fps: np.ndarray, near: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Pairs that join the fingerprints of one group; within reach of each other means joined.

    Sorted by the first coordinate, each looks only at those whose first coordinate is within the
    radius and that no pair has yet joined to it; the other coordinates, then the bits, decide. The
    radius grows in steps, so that near pairs join before far ones.
    """
    order = np.argsort(near[:, 0], kind="stable")
    fps, near = fps[order], near[order].astype(np.int64)
    label = np.arange(len(fps))
    out = []
    for radius in (limit // 2, limit * 3 // 4, limit) if limit > EXACT_LIMIT else (limit,):
        upto = np.searchsorted(near[:, 0], near[:, 0] + radius, "right")
        for i in range(len(fps)):
            other = np.arange(i + 1, upto[i])
            other = other[label[other] != label[i]]
            if not other.size:
                continue
            other = other[np.abs(near[other] - near[i]).max(axis=1) <= radius]
            other = other[_distance(fps[other], fps[i]) <= radius]
            for j in other.tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    out.append((int(order[i]), int(order[j])))
    return out


def _pairs(keys: np.ndarray, fps: np.ndarray, near: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of edges within the runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    small = (sizes > 1) & (sizes <= 8)
    for step in range(1, 8):  # all small runs at once, neighbours at each distance
        s = starts[small & (sizes > step)]
        n = sizes[small & (sizes > step)] - step
        i = np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i = i[np.abs(near[i].astype(np.int16) - near[i + step]).max(axis=1, initial=0) <= limit]
        i = i[_distance(fps[i], fps[i + step]) <= limit]
        a.append(i), b.append(i + step)
    for s, n in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
        links = np.array(_links(fps[s : s + n], near[s : s + n], limit), np.int64).reshape(-1, 2)
        a.append(s + links[:, 0]), b.append(s + links[:, 1])
    return np.concatenate(a), np.concatenate(b)


def _words(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in names], axis=1).view(np.uint64)


def _near(column: pa.Array) -> np.ndarray:
    """Coordinates packed in a long, one a byte."""
    return np.ascontiguousarray(column.to_numpy()).view(np.uint8).reshape(-1, SPREAD)


def _matched(rows: DataFrame, names: list[str], limit: int) -> DataFrame:
    """Edges (a, b) of the nodes whose fingerprints are within the limit, inside groups of equal key."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def edges(rows: pa.RecordBatch) -> pa.RecordBatch:
            a, b = _pairs(rows.column("key").to_numpy(), _words(rows, names), _near(rows.column("near")), limit)
            node, fps = rows.column("node"), _words(rows, names)
            return pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b)), pa.array(_distance(fps[a], fps[b]), pa.int32())], names=["a", "b", "apart"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if cut or held and held[-1].column("key")[-1].as_py() != keys[-1]:
                yield edges(pa.concat_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield edges(pa.concat_batches(held))

    kind = rows.schema["node"].dataType.simpleString()
    # in one order, so that the same edges are chosen again after a lost executor
    return rows.repartition("key").sortWithinPartitions("key", *names).mapInArrow(match, f"a {kind}, b {kind}, apart int")


def _hot_links(rows: DataFrame, names: list[str], limit: int, block: int) -> DataFrame:
    """Edges inside keys of many fingerprints, none of which is compared within its most common hub's group."""
    kind = rows.schema["node"].dataType.simpleString()
    hubs = [F.min(F.struct(F.xxhash64(F.lit(h), *names).alias("_"), *names, "node")).alias(f"hub{h}") for h in range(HUBS)]
    joined = rows.join(rows.groupBy("key").agg(*hubs), "key")
    flat = joined.select("key", *names, "near", "node", *[F.col(f"hub{h}")[c].alias(f"{c}_{h}") for h in range(HUBS) for c in [*names, "node"]])

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, to = _words(batch, names), np.stack([_words(batch, [f"{c}_{h}" for c in names]) for h in range(HUBS)], axis=1)
            apart = _distance(own[:, None, :], to)
            near = apart <= limit
            joined = _distance(to[:, :, None, :], to[:, None, :, :]) <= limit  # hubs with hubs
            for _ in range(HUBS.bit_length()):
                joined = (joined.astype(np.int8) @ joined.astype(np.int8)) > 0
            label = np.where(near.any(axis=1), joined.argmax(axis=2)[np.arange(len(own)), near.argmax(axis=1)], -1)
            hubs = [batch.column(f"node_{h}").filter(pa.array(near[:, h])) for h in range(HUBS)]
            by_row = pa.array(np.argsort(np.concatenate([np.flatnonzero(near[:, h]) for h in range(HUBS)]), kind="stable"))
            links = pa.StructArray.from_arrays([pa.concat_arrays(hubs).take(by_row), pa.array(apart[near], pa.int32())], names=["hub", "apart"])
            links = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(near.sum(axis=1))], pa.int32()), links)
            columns = [batch.column(c) for c in ("key", *names, "near", "node")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(label, pa.int32()), links], names=["key", *names, "near", "node", "label", "links"])

    ddl = ", ".join(["key long", *(f"{c} long" for c in names), "near long", f"node {kind}", "label int", f"links array<struct<hub:{kind},apart:int>>"])
    seen = stored(flat.mapInArrow(cover, ddl), "hot")
    edges = seen.select("node", F.explode("links").alias("to")).select(F.col("node").alias("a"), F.col("to.hub").alias("b"), "to.apart").where("a <> b")

    counts = seen.groupBy("key", "label").agg(F.count("*").alias("n"))
    most = counts.where("label >= 0").groupBy("key").agg(F.max(F.struct("n", "label"))["label"].alias("most"))
    every = counts.join(most, "key", "left").withColumn("most", F.coalesce("most", F.lit(-2))).groupBy("key", "most")
    every = every.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("label") != F.col("most"), F.col("n"))), F.lit(0)).alias("apart")).where("apart > 0")
    dealt = seen.drop("links").join(every, "key")
    m, q = (F.ceil(F.col(c) / block).cast("int") for c in ("n", "apart"))
    own = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    member = F.transform(F.sequence(F.lit(0), q - 1), lambda j: F.struct(own(1, m).alias("i"), j.alias("j")))
    visitor = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.struct(i.alias("i"), own(2, q).alias("j")))
    cells = F.array_distinct(F.when(F.col("label") != F.col("most"), F.concat(member, visitor)).otherwise(member))
    dealt = dealt.withColumn("cell", F.explode(cells)).withColumn("key", F.xxhash64("key", "cell.i", "cell.j"))
    return edges.unionByName(_matched(dealt.select("key", *names, "near", "node"), names, limit))


def near_links(reps: DataFrame, *, bits: int = 64, limit: int = 4, recall: float = 0.95, usual: int | None = None, block: int = BLOCK) -> DataFrame:
    """Edges (a, b, apart) that join all nodes whose fingerprints are within `limit` bits. reps: distinct fp, node.

    With random keys a pair that is `usual` (else `limit`) bits apart is found with probability `recall`.
    """
    index = pivots(reps.count(), bits, limit, recall, usual)
    names = [f"w{w}" for w in range(bits // 64)]
    kind = reps.schema["node"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                fps = _words(batch, names)
                table = index.table(fps)
                keys = index.keys(table)
                near = np.minimum(table[:, -SPREAD:], 255).astype(np.uint8).view(np.int64)[:, 0]
                n = keys.shape[1]
                columns = [pa.array(keys.reshape(-1).view(np.int64)), *(pa.array(np.repeat(fps[:, w].view(np.int64), n)) for w in range(len(names))), pa.array(np.repeat(near, n))]
                yield pa.RecordBatch.from_arrays([*columns, batch.column("node").take(pa.array(np.repeat(np.arange(len(fps)), n)))], names=["key", *names, "near", "node"])

    flat = reps.select(*[F.col("fp")[w].alias(c) for w, c in enumerate(names)], "node")
    dealt = flat.mapInArrow(deal, ", ".join(["key long", *(f"{c} long" for c in names), "near long", f"node {kind}"]))
    hot = stored(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("key"), "hot-keys")
    if hot.isEmpty():
        return _matched(dealt, names, limit)
    cool = _matched(dealt.join(hot, "key", "left_anti"), names, limit)
    return cool.unionByName(_hot_links(dealt.join(hot, "key", "left_semi"), names, limit, block))


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, limit: int = 4, bits: int = 64, distinct: bool = False,
    recall: float = 0.95, block: int = BLOCK,
) -> DataFrame:
    """(id, fingerprint, component_id) for each row of docs; component_id is the least id reachable.

    Texts are linked within `limit` of `bits` bits; up to EXACT_LIMIT no link is lost, beyond it one
    at the limit is found with probability `recall`, and nearer ones with more. distinct: each
    shingle counts once, so that limit_of(similarity, bits) bits stand for a Jaccard similarity.
    The id may be of any orderable type. Only the id and the text are read, so other columns of docs
    may have any name.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = stored(with_fingerprints(docs, width=width, bits=bits, distinct=distinct).select("id", "fp"), "fingerprints")
    reps = stored(nodes_of(marked), "fingerprints-distinct")
    roots = components(near_links(reps, bits=bits, limit=limit, recall=recall, block=block), "a", "b")
    of = reps.join(roots, "node", "left").select("fp", F.coalesce("root", "node")["id"].alias("component_id"))
    text = F.array_join(F.transform(F.reverse("fp"), lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), "")
    return marked.join(of, "fp").select(F.col("id").alias(id_col), text.alias("fingerprint"), "component_id")


def nodes_of(marked: DataFrame) -> DataFrame:
    """(fp, node): distinct fingerprints with a node each, which sorts by the least id, ids that are all null last."""
    reps = marked.groupBy("fp").agg(F.min("id").alias("_id"))
    return reps.select("fp", F.struct(F.col("_id").isNull().alias("orphan"), F.col("_id").alias("id"), F.xxhash64("fp").alias("by")).alias("node"))

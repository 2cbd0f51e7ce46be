"""Near-duplicates at a Jaccard similarity of word shingles: SimHash finds groups, an exact join finds the links it left out.

Nodes are distinct shingle sets (`width` words a shingle), by 128-bit digest.

1. Links by op2's operator, with fingerprints wide enough for a similarity of `least`: pivot tables, up to MARGIN deviations beyond the distance that
   `least` stands for. A pair at that distance is found with probability `recall`.
2. The nearest link of each node is verified on the texts (exact similarity of both sets) and joins groups; then the nearest link between two
   groups is. No link is taken unverified.
3. Links between the groups that are left, by prefixes: with all shingles in one order, two sets of similarity `least` share one of
   their first n - ceil(least * n) + 1. Nodes meet by these; pairs of one group, of too different sizes, or whose places in the order leave
   too little to share are dropped, and the others are verified. This escapes no pair, so groups are those of all pairs, whatever step 1 missed.
   Before texts travel, pairs are dropped whose parity sketches differ in more bits than sets of similarity `least` can (`sketch`): a bound, so no link is lost.
   Frequent shingles come last in the order. How frequent they are is taken from a sample, which decides the work and not the result.
4. Components of all verified links.

Nulls and ties: null or word-less texts have the same, empty set; fewer words than the width are one
shingle; repeated rows share a component; a null id is kept as a row and gets the least non-null id
of its component (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, scratch, shuffles_removed, slices, stored, texts_of, with_columns
from .components import components
from .simhash import BLOCK, limit_of, near_links, shingle_hashes, words_of

BITS = 256
#: Standard deviations of a pair's distance beyond it that are still asked.
MARGIN = 2.0
#: Sets of the sample for the order of shingles, times in it from which a shingle counts as frequent, and frequent ones that are told apart.
SAMPLE, OFTEN, MOST_FREQUENT = 5_000, 5, 50_000
#: Hashes of a set from which it has a sketch.
SKETCHED = 96


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(text, width))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; of two empty ones 1."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of a set's hashes in buckets, about one a hash: sketches of two sets differ in no more bits than the sets differ in hashes.

    Empty for a set of few hashes, whose text is hardly longer than the rows that a sketch would spare.
    """
    if len(hashes) < SKETCHED:
        return b""
    bits = 64 << max(0, (len(hashes) - 1).bit_length() - 6)
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(s: bytes, size: int) -> np.ndarray:
    """A sketch as one of fewer buckets, a power of two."""
    x = np.frombuffer(s, "<u8")
    while 8 * len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def may_be_similar(n: int, s: bytes, m: int, t: bytes, least: float) -> bool:
    """Whether sets of n and m hashes with these sketches can have a similarity of `least`."""
    size = min(len(s), len(t))
    apart = max(abs(n - m), int(np.bitwise_count(_folded(s, size) ^ _folded(t, size)).sum()) if size else 0)
    return n + m - apart >= 2 * least / (1 + least) * (n + m) - 1e-9  # those in both, twice


def _possible(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sketches (node, n, sketch) do not rule a similarity of `least` out."""
    kind = pairs.schema["a"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sides = (batch.column(c).to_pylist() for c in ("na", "sa", "nb", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array([may_be_similar(*x, least) for x in zip(*sides, strict=True)], pa.bool_()))

    both = pairs.join(sketches.toDF("b", "nb", "sb"), "b").join(sketches.toDF("a", "na", "sa"), "a")
    return both.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(each, f"a {kind}, b {kind}")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    kind = pairs.schema["a"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = lru_cache(maxsize=256)(lambda text: shingle_set(text, width))
        for batch in slices(batches):
            near = [similarity(shingles(x), shingles(y)) >= least for x, y in zip(texts_of(batch, "ta"), texts_of(batch, "tb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))
        pa.default_memory_pool().release_unused()

    both = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(each, f"a {kind}, b {kind}")


def _frequent(sets: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the shingles that many sets of a sample have. They only order shingles."""
    n = max(sets.count() // SAMPLE, 1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(t, width) for t in texts_of(batch, "text")]).view(np.int64))], names=["h"])

    counts = sets.where(F.pmod("by", F.lit(n)) == 0).select("text").mapInArrow(each, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    rows = counts.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toArrow()  # of bounded length
    h, n = rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(hashes: np.ndarray, least: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first hashes of a sorted set, in the common order, of which sets of similarity `least` share one."""
    names, counts = frequent
    often = np.zeros(len(hashes), np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
        often = np.where(names[at] == hashes, counts[at], 0)
    return hashes[np.argsort(often, kind="stable")][: len(hashes) - int(np.ceil(least * len(hashes) - 1e-9)) + 1]


def _met(batch: pa.RecordBatch, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of one shingle that may be similar and are of different groups; the rows are sorted by shingle and size."""
    token, size, place, by = (batch.column(c).to_numpy() for c in ("token", "size", "place", "by"))
    group = pc.coalesce(batch.column("root"), batch.column("by")).to_numpy()
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    ends = np.repeat(np.r_[starts[1:], len(token)], np.diff(np.r_[starts, len(token)]))
    differs = np.add.reduceat(np.r_[False, (token[1:] == token[:-1]) & (group[1:] != group[:-1])], starts) > 0 if len(starts) else np.empty(0, bool)
    alive = np.flatnonzero(np.repeat(differs, np.diff(np.r_[starts, len(token)])))
    a, b, step = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 1
    while len(alive):  # neighbours at each distance, until sizes differ too much
        alive = alive[alive + step < ends[alive]]
        alive = alive[size[alive] >= least * size[alive + step] - 1e-9]
        i, j = alive, alive + step
        both = size[i] + size[j]
        ok = (group[i] != group[j]) & (np.minimum(size[i] - place[i], size[j] - place[j]) >= np.ceil(least / (1 + least) * both - 1e-9))
        a.append(np.minimum(by[i[ok]], by[j[ok]])), b.append(np.maximum(by[i[ok]], by[j[ok]]))
        step += 1
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def exact_pairs(sets: DataFrame, width: int, least: float) -> DataFrame:
    """Distinct (a, b) by the number `by`: all pairs of different groups whose sets may have a similarity of `least`, and few others.

    sets: by (long), root (the group, a long; null for a set on its own, whose group is itself), text.
    """
    frequent = _frequent(sets, width)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            of = [shingle_set(t, width) for t in texts_of(batch, "text")]
            first = [prefix(h, least, frequent) for h in of]
            n = np.array([len(p) for p in first], np.int64)
            row = np.repeat(np.arange(len(of)), n)
            size, place = np.array([len(h) for h in of], np.int32)[row], (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            columns = [pa.array(np.concatenate(first).view(np.int64)), *(batch.column(c).take(pa.array(row)) for c in ("by", "root")), pa.array(size), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "by", "root", "size", "place"])
        pa.default_memory_pool().release_unused()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(rows: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _met(rows, least)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = batch.column("token").to_numpy()
            cut = int(np.searchsorted(tokens, tokens[-1]))  # the last shingle may go on in the next batch
            if cut or held and held[-1].column("token")[-1].as_py() != tokens[-1]:
                yield pairs(pa.concat_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield pairs(pa.concat_batches(held))

    dealt = sets.select("by", "root", "text").mapInArrow(deal, "token long, by long, root long, size int, place int")
    return dealt.repartition("token").sortWithinPartitions("token", "size", "by").mapInArrow(meet, "a long, b long").distinct()


def near_copies(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, bits: int = BITS, recall: float = 0.97, block: int = BLOCK
) -> DataFrame:
    """(id, component_id) for each row of docs; component_id is the least id reachable.

    Only the id and the text are read, so other columns of docs may have any name.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    kept = Tables(spark)  # what the returned frame reads; all else goes at the end
    try:
        with scratch(spark), shuffles_removed(spark):
            marked, nodes, roots = _grouped(docs, kept, width, least, bits, recall, block)
    except BaseException:
        kept.clear()
        raise
    of = nodes.join(roots, "node", "left").select("shingles", F.coalesce("root", "node")["id"].alias("component_id"))
    return marked.join(of, "shingles").select(F.col("id").alias(id_col), "component_id")


def _grouped(docs: DataFrame, kept: Tables, width: int, least: float, bits: int, recall: float, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, shingles) of all rows, (shingles, node) of all sets, (node, root) of those that are linked. What only one step reads goes after it."""
    spark = docs.sparkSession
    work = Tables(spark)

    def marks(texts: list[bytes]) -> tuple[list, ...]:
        sets = [shingle_set(t, width) for t in texts]
        return [words_of(h, bits // 64).view(np.int64) for h in sets], [xxhash.xxh3_128_digest(h.tobytes()) for h in sets], list(map(len, sets)), list(map(sketch, sets))

    with scratch(spark):
        every = stored(with_columns(docs, "text", "fp array<long>, shingles binary, n int, sketch binary", [pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary()], lambda: marks), "fingerprints")
        marked = kept.stored(every.select("id", "shingles"), "marked")
        reps = every.groupBy("shingles").agg(F.min("id").alias("_id"), *[F.min(c).alias(c) for c in ("fp", "text", "n", "sketch")])
        node = F.struct(F.col("_id").isNull().alias("orphan"), F.col("_id").alias("id"), F.xxhash64("shingles").alias("by")).alias("node")
        sets = work.stored(reps.select("shingles", "fp", "text", "n", "sketch", node), "sets")
    nodes = kept.stored(sets.select("shingles", "node"), "nodes")
    most = max(nodes.count(), 1)
    numbered = nodes.select(F.col("node.by").alias("_by"), "node")

    def named(pairs: DataFrame) -> DataFrame:
        """Pairs of numbers as pairs of nodes."""
        for end in ("a", "b"):
            pairs = pairs.withColumnRenamed(end, "_by").join(numbered.withColumnRenamed("node", end), "_by").drop("_by")
        return pairs

    def checked(pairs: DataFrame) -> DataFrame:
        with scratch(spark):
            pairs = stored(_possible(stored(pairs, "pairs"), sets.select("node", "n", "sketch"), least), "pairs")
            asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            texts = stored(sets.select("node", "text").join(asked, "node"), "texts")
            rounds = max(1, -(-pairs.count() // most))  # no more pairs with their texts at once than there are sets
            own = [pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == r) for r in range(rounds)]
            return reduce(DataFrame.unionByName, [work.stored(_verified(p, texts, width, least), "verified") for p in own])

    usual = limit_of(least, bits)
    limit = usual + int(MARGIN * sqrt(usual * (1 - usual / bits)))
    with scratch(spark):  # fingerprints meet by number, which is shorter than a node
        near = stored(near_links(sets.select("fp", F.col("node.by").alias("node")), bits=bits, limit=limit, recall=recall, usual=usual, block=block), "near")
        links = work.stored(named(near), "links")

    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
    nearest = both.groupBy("a").agg(F.min(F.struct("apart", "b"))["b"].alias("b"))
    found = checked(nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = components(found, "a", "b")
    open_ = links
    for end in ("a", "b"):
        of = labels.select(F.col("node").alias(end), F.col("root").alias(f"of_{end}"))
        open_ = open_.join(of, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    best = F.min(F.struct("apart", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).alias("best")
    pairs = open_.where("of_a <> of_b").groupBy(F.least("of_a", "of_b").alias("x"), F.greatest("of_a", "of_b").alias("y")).agg(best)
    found = work.stored(found.unionByName(checked(pairs.select("best.a", "best.b"))), "found")
    work.clear(sets, found)

    # what fingerprints left out: exact, between the groups that there are now; one row a set
    own = sets.select("node", "text").join(components(found, "a", "b"), "node", "left").select(F.col("node.by").alias("by"), F.col("root.by").alias("root"), "text")
    late = checked(named(exact_pairs(own, width, least)))
    return marked, nodes, kept.stored(components(found.unionByName(late), "a", "b"), "roots")

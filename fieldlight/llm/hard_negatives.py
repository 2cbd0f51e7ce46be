"""Hard negatives from Parquet blocks in the order of a Hilbert curve, chosen by zone maps.

1. Vectors become integers. Rows are sorted by label and their place on a Hilbert curve through the
   dimensions that vary most, and written as blocks of BLOCK_ROWS rows of one label with the least and
   largest value of every dimension (the zone map).
2. Anchors leave their blocks in groups of neighbours, each with the score of its last positive inside its own block.
3. Groups meet pages of zone maps, never vectors. Interval arithmetic gives the least and largest score that a
   block can have with an anchor: a block is read for an anchor's positives only if it may reach the known
   score, and for the window of a positive only if its scores may fall into the window.
4. A group goes once to each cell (CELL_BLOCKS blocks in a row) of its chosen blocks; a task keeps the best rows of each
   window and reports those; reports meet in a window function. Positives come first, then the windows that they open.

All rows are searched for every anchor: bounds only leave out blocks that cannot have a result. Work is in tiles
of bounded size (a group by a page, a group by a block), and nothing is broadcast or collected: joins are merges, since
Spark judges a stored table by its compressed bytes, and vectors and windows are many times as large in the driver; a label, vector or place on the curve that many rows share is cut into many blocks by id.

Defined results: rows without an id, a label or a vector, or with a null or non-finite component take no part.
Vectors of different lengths are filled up with zeros. Components so large that inner products might not fit a
long saturate. Ids must be integers that fit a long. Repeated rows take part each; an anchor's positives and
negatives are rows with other ids, and an anchor that is repeated is searched for each time. Other columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Tables, partitions

BLOCK_ROWS = 256
GROUP_ROWS = 256
PAGE_BLOCKS = 1024
CELL_BLOCKS = 32
#: Dimensions and bits of the Hilbert curve.
CURVE_DIMS, CURVE_BITS = 16, 4
#: Groups whose best rows a task keeps at once.
HELD = 256
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def hilbert(levels: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve, as rows of bytes, of points with integer coordinates below 2**bits (n, dims)."""
    x = levels.astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:  # from the top bit down: turn and mirror the cell that the point is in
        p = q - 1
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).astype(np.uint8), axis=0).T


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in floating point where all sums are below 2**53."""
    size = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if size < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest score of each anchor with any vector between low and high, per block."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return inner(up, low) + inner(down, high), inner(up, high) + inner(down, low)


def _integers(batch: pa.RecordBatch, scale: float, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their vectors as integers."""
    column = batch.column("vector")
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten()
    ok = np.isfinite(values.to_numpy(zero_copy_only=False).astype(np.float64)) & values.is_valid().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    bad = np.concatenate([[0], np.cumsum(~ok)])
    good = bad[starts + sizes] == bad[starts]
    raw = np.where(ok, values.to_numpy(zero_copy_only=False).astype(np.float64), 0.0)
    most = isqrt(2**55 // dims)  # a hundred scores fit a long
    with np.errstate(over="ignore"):
        raw = np.clip(np.floor(raw * scale), -most, most).astype(np.int32)
    out = np.zeros((len(sizes), dims), np.int32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(raw)) - np.repeat(starts, sizes)] = raw
    return good, out[good]


def _sums(scale: float, dims: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            _, v = _integers(batch, scale, dims)
            v = v.astype(np.float64)
            n, total, squares = n + len(v), total + v.sum(0), squares + (v * v).sum(0)
        yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(dims, dtype=np.int32)), "n": pa.array(np.full(dims, n)), "total": pa.array(total), "squares": pa.array(squares)})

    return each


def _placed(scale: float, dims: int, use: list[int], mean: np.ndarray, spread: np.ndarray):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, v = _integers(batch, scale, dims)
            levels = np.clip((v[:, use] - mean) / (4 * spread) + 0.5, 0, 1 - 1e-9) * (1 << CURVE_BITS)
            keys = hilbert(levels, CURVE_BITS) if use else np.zeros((len(v), 1), np.uint8)
            rest = batch.select(["label", "id", "anchor"]).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([x.tobytes() for x in v], pa.binary())],
                                             names=["label", "id", "anchor", "place", "vec"])

    return each


BLOCK_DDL = "block long, label string, rows int, ids binary, vecs binary, marks binary, low binary, high binary"
_BLOCK = pa.schema([("block", pa.int64()), ("label", pa.string()), ("rows", pa.int32()), *[(n, pa.binary()) for n in ("ids", "vecs", "marks", "low", "high")]])


def _blocks(dims: int, size: int):
    """Runs of up to size rows with one label, in order of ids inside a block, so that earlier columns of a tie have smaller ids."""

    def row(number: int, label: str, batch: pa.Table) -> dict:
        ids = batch["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        v = np.frombuffer(b"".join(batch["vec"].to_pylist()), np.int32).reshape(len(ids), dims)[order]
        marks = np.packbits(batch["anchor"].to_numpy()[order])
        return {"block": number, "label": label, "rows": len(ids), "ids": ids[order].tobytes(), "vecs": v.tobytes(), "marks": marks.tobytes(), "low": v.min(0).tobytes(), "high": v.max(0).tobytes()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None
        for batch in _and_none(batches):
            if batch is not None:
                now = pa.Table.from_batches([batch])
                held = pa.concat_tables([held, now]).combine_chunks() if held is not None else now
            if held is None or (batch is not None and held.num_rows < size):
                continue
            labels = np.asarray(held["label"].to_pylist(), object)
            cuts = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)]
            done, out = 0, []
            for a, b in zip(cuts, cuts[1:], strict=False):
                for at in range(a, b, size):
                    end = min(b, at + size)
                    if end == len(labels) and batch is not None and end - at < size:
                        break  # may go on in the next batch
                    out.append(row(number, labels[at], held.slice(at, end - at)))
                    number, done = number + 1, end
            held = held.slice(done)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_BLOCK)

    return each


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


GROUP_DDL = "group long, label string, ids binary, vecs binary, slots array<struct<slot:int,at:int,low:long,high:long>>"
_SLOT = pa.struct([("slot", pa.int32()), ("at", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])
_GROUP = pa.schema([("group", pa.int64()), ("label", pa.string()), ("ids", pa.binary()), ("vecs", pa.binary()), ("slots", pa.list_(_SLOT))])


def _groups(dims: int, k: int, size: int):
    """Anchors of neighbouring blocks of one label, with the score that a positive must reach: that of the k-th in the anchor's own block."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, label, held = TaskContext.get().partitionId() << 32, None, []

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            while held:
                ids, vecs, least = (np.concatenate(x) for x in zip(*held, strict=True))
                slots = [{"slot": i, "at": i, "low": int(t), "high": int(MOST)} for i, t in enumerate(least[:size])]
                yield pa.RecordBatch.from_pylist([{"group": number, "label": label, "ids": ids[:size].tobytes(), "vecs": vecs[:size].tobytes(), "slots": slots}], schema=_GROUP)
                number, held = number + 1, [(ids[size:], vecs[size:], least[size:])] if len(ids) > size else []

        for batch in batches:
            for b in batch.to_pylist():
                if b["label"] != label:
                    yield from closed()
                    label = b["label"]
                ids, v = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["vecs"], np.int32).reshape(-1, dims)
                mine = np.unpackbits(np.frombuffer(b["marks"], np.uint8))[: len(ids)].astype(bool)
                if not mine.any():
                    continue
                scores = np.where(ids[mine][:, None] == ids, LEAST, inner(v[mine], v))
                least = np.sort(scores, 1)[:, -k] if len(ids) >= k else np.full(mine.sum(), LEAST)
                held.append((ids[mine], v[mine], least))
                if sum(len(x[0]) for x in held) >= size:
                    yield from closed()
        yield from closed()

    return each


PAGE_DDL = "page long, blocks binary, labels array<string>, lows binary, highs binary"
_PAGE = pa.schema([("page", pa.int64()), ("blocks", pa.binary()), ("labels", pa.list_(pa.string())), ("lows", pa.binary()), ("highs", pa.binary())])


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Zone maps of up to PAGE_BLOCKS blocks in a row."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at in range(0, batch.num_rows, PAGE_BLOCKS):
            part = batch.slice(at, PAGE_BLOCKS)
            row = {"page": number, "blocks": part["block"].to_numpy().tobytes(), "labels": part["label"].to_pylist(), "lows": b"".join(part["low"].to_pylist()), "highs": b"".join(part["high"].to_pylist())}
            yield pa.RecordBatch.from_pylist([row], schema=_PAGE)
            number += 1


def _slots(row: dict) -> tuple[np.ndarray, ...]:
    s = pa.array(row["slots"], _SLOT)
    return tuple(s.field(i).to_numpy(zero_copy_only=False) for i in range(4))


CHOSEN_DDL = "group long, block long, mask binary"


def _choose(dims: int, same: bool):
    """Blocks that a group must read, with the windows that need them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                blocks = np.frombuffer(row["blocks"], np.int64)
                fits = np.array([(x == row["label"]) == same for x in row["labels"]], bool)
                _, at, low, high = _slots(row)
                v = np.frombuffer(row["vecs"], np.int32).reshape(-1, dims)
                lows, highs = (np.frombuffer(row[k], np.int32).reshape(-1, dims)[fits] for k in ("lows", "highs"))
                least, most = bounds(v, lows, highs)
                need = (most[at] >= low[:, None]) & (least[at] <= high[:, None])
                some = need.any(0)
                masks = np.packbits(need[:, some], axis=0).T
                yield pa.RecordBatch.from_pydict({"group": pa.array(np.full(some.sum(), row["group"])), "block": pa.array(blocks[fits][some]), "mask": pa.array([m.tobytes() for m in masks], pa.binary())})

    return each


FOUND_DDL = "group long, slot int, own long, id long, score long"


def _read(dims: int, k: int):
    """The k best rows of each window, over the blocks that this task reads."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, ...]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for group, (slot, own, scores, ids, there) in held.items():
                s, c = np.nonzero(there)
                yield pa.RecordBatch.from_pydict({"group": pa.array(np.full(len(s), group)), "slot": pa.array(slot[s]), "own": pa.array(own[s]), "id": pa.array(ids[s, c]), "score": pa.array(scores[s, c])})
            held.clear()

        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                slot, at, low, high = _slots(row)
                own = np.frombuffer(row["ids"], np.int64)
                v = np.frombuffer(row["vecs"], np.int32).reshape(-1, dims)
                ids = np.frombuffer(row["block_ids"], np.int64)
                if row["group"] not in held:
                    if len(held) >= HELD:
                        yield from flushed()
                    n = len(slot)
                    held[row["group"]] = slot, own[at], np.full((n, k), LEAST), np.full((n, k), MOST), np.zeros((n, k), bool)
                mask = np.flatnonzero(np.unpackbits(np.frombuffer(row["mask"], np.uint8))[: len(slot)])
                scores = inner(v, np.frombuffer(row["block_vecs"], np.int32).reshape(-1, dims))[at[mask]]
                there = (scores >= low[mask, None]) & (scores <= high[mask, None]) & (own[at[mask]][:, None] != ids)
                _, _, old_scores, old_ids, old_there = held[row["group"]]
                some = np.flatnonzero((there & (scores >= old_scores[mask, -1:])).any(1))  # windows that this block may change
                mask, scores, there = mask[some], scores[some], there[some]
                best = np.argsort(np.where(there, -scores, MOST), axis=1, kind="stable")[:, :k]  # ties: smaller ids stand first
                scores, there, ids = (np.concatenate(x, 1) for x in (
                    (old_scores[mask], np.take_along_axis(scores, best, 1)), (old_there[mask], np.take_along_axis(there, best, 1)), (old_ids[mask], ids[best])))
                order = np.lexsort((ids, -scores, ~there), axis=1)[:, :k]
                there = np.take_along_axis(there, order, 1)
                old_there[mask] = there
                old_scores[mask] = np.where(there, np.take_along_axis(scores, order, 1), LEAST)
                old_ids[mask] = np.take_along_axis(ids, order, 1)
        yield from flushed()

    return each


def hard_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label", scale: float = 256,
    positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors: a condition on rows. A score is the inner product of vectors whose components are floor(scale * x); higher
    is better, ties go to the smaller id. An anchor's positives are its first other rows of its label; a
    positive's negatives are the first rows of other labels with least * positive_score <= 100 * score <= most * positive_score.
    """
    spark = rows.sparkSession
    tables, shards = Tables(spark), partitions(spark)
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    taken = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("vector"))
    taken = taken.where("id is not null and label is not null and vector is not null")
    dims = taken.agg(F.max(F.size("vector"))).head()[0] or 0
    if not dims:  # no vector, or only empty ones: all scores are zero
        dims, taken = 1, taken.withColumn("vector", F.array(F.lit(0.0)))
    sums = taken.select("vector").mapInArrow(_sums(scale, dims), "dim int, n long, total double, squares double").groupBy("dim").agg(F.sum("n"), F.sum("total"), F.sum("squares"))
    stats = {r[0]: (r[2] / max(1, r[1]), r[3] / max(1, r[1])) for r in sums.collect()}  # one row a dimension
    variance = {i: max(0.0, q - m * m) for i, (m, q) in stats.items()}
    use = sorted(sorted(variance, key=lambda i: (-variance[i], i))[:CURVE_DIMS])
    mean, spread = np.array([stats[i][0] for i in use]), np.array([max(variance[i], 1e-9) ** 0.5 for i in use])

    placed = taken.mapInArrow(_placed(scale, dims, use, mean, spread), "label string, id long, anchor boolean, place binary, vec binary")
    order = ["label", "place", "id"]
    blocks = tables.stored(placed.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(_blocks(dims, block_rows), BLOCK_DDL), "blocks")
    groups = tables.stored(blocks.select("label", "ids", "vecs", "marks").mapInArrow(_groups(dims, positives, group_rows), GROUP_DDL), "groups")
    pages = tables.stored(blocks.select("block", "label", "low", "high").mapInArrow(_pages, PAGE_DDL), "pages")
    vectors = blocks.select("block", F.col("ids").alias("block_ids"), F.col("vecs").alias("block_vecs"))

    cell = F.floor(F.col("block") / CELL_BLOCKS).alias("cell")
    vectors = vectors.select("*", cell)
    spread_out = max(1, min(shards, pages.count()))

    def met(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        """A join in all tasks; the rows of right with one key are few, those of left stream past them."""
        return left.repartition(shards, key).hint("merge").join(right.repartition(shards, key), key)

    def searched(groups: DataFrame, same: bool, k: int) -> DataFrame:
        """The k best rows of every window of the groups, with rank."""
        dealt = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(spread_out - 1))))
        tiles = met(dealt, pages.withColumn("shard", F.pmod(F.xxhash64("page"), F.lit(spread_out)).cast("int")), "shard").drop("shard", "ids")
        chosen = tables.stored(tiles.mapInArrow(_choose(dims, same), CHOSEN_DDL), "chosen")
        wanted = chosen.repartition(shards, "group").groupBy("group", cell).agg(F.map_from_entries(F.collect_list(F.struct("block", "mask"))).alias("wanted"))
        read = met(met(wanted, groups, "group"), vectors, "cell").withColumn("mask", F.try_element_at("wanted", "block")).where("mask is not null")
        read = read.drop("wanted", "cell", "block", "label")
        found = read.mapInArrow(_read(dims, k), FOUND_DDL)
        first = Window.partitionBy("group", "slot").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)

    near = tables.stored(searched(groups, True, positives), "positives")
    slot = (F.col("slot") * positives + F.col("rank") - 1).alias("slot")
    windows = near.select("group", slot, F.col("slot").alias("at"), F.expr(f"score * {least} div 100 + if(score * {least} % 100 > 0, 1, 0)").alias("low"),
                          F.expr(f"score * {most} div 100 - if(score * {most} % 100 < 0, 1, 0)").alias("high")).where("low <= high")
    windows = windows.groupBy("group").agg(F.collect_list(F.struct(F.col("slot"), F.col("at"), F.col("low"), F.col("high"))).alias("slots"))  # a group's anchors times positives
    groups = tables.stored(groups.drop("slots").hint("merge").join(windows, "group"), "groups")
    far = searched(groups, False, negatives).select("group", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select("group", slot, F.col("own").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = tables.stored(near.hint("merge").join(far, ["group", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    tables.clear(out)
    return out

"""Exact duplicates by deterministic block naming, in DataFrame operations alone.

A text is cut into blocks of BLOCK bytes. The different blocks are sorted and their ranks are their
names: integers that are equal only where the blocks are. Then neighbouring names are paired, the
different pairs are sorted and named in turn, and so on until every text has one name; a text of k
blocks takes ceil(log2 k) rounds, each over half the rows of the one before. Texts are equal exactly
when they took as many rounds and have the same name.

Names are given to bytes, never to hashes. Texts look their blocks' names up by a 128-bit hash, so that
bytes are shuffled once, and only one copy of what a task has seen; if ever two different blocks share
a hash, which the name table shows, names are looked up by the bytes themselves.

Name tables and rounds are written to the shared folder: names are the same for all who read them, and a
lost executor costs one round. Copies of a block in one task are merged before the shuffle; lookups join
two plain exchanges, so that adaptive execution may split a hot block, pair or group.

Defined results: a null text is the empty text (one empty block). A null id is smaller than any
other. Of repeated rows (one id and one text) one is kept; every row is returned. Ids may have any type
that has an order. Columns besides the id and the text are not read, so their names cannot clash. An
empty table gives an empty result. A text may be as long as a value can be (2 GB).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables

#: Bytes of a block, and of the pieces from which blocks are cut, so that a long text is not copied once a block.
BLOCK = 4096
PIECE = 256 * BLOCK


def _cut(data: Column, size: int) -> Column:
    """A binary value in parts of size bytes, one at least."""
    last = F.greatest(F.lit(0), F.floor((F.octet_length(data) - 1) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _key(block: Column, bits: int) -> Column:
    """Two hashes with different seeds, of so many bits each."""
    each = [F.xxhash64(block), F.xxhash64(F.lit(1), block)]
    return F.struct(*[(h if bits == 64 else F.shiftrightunsigned(h, 64 - bits)).alias(n) for h, n in zip(each, "ab", strict=True)])


def _named(things: DataFrame, *keys: str) -> DataFrame:
    """Different rows with their rank in a sorted partition, its number in front. The result is written before anyone reads it twice."""
    return things.distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest",
    normalise: Callable[[Column], Column] | None = None, key_bits: int = 64,
) -> DataFrame:
    """One row per row of docs: its id, and keep_id, group_size, kept and text_sha256 of its group of equal texts.

    keep: whether the row with the "largest" or the "smallest" id of a group stays. normalise: a column expression that
    texts pass before they are compared. key_bits: bits of each of the two hashes by which names are looked up.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep must be 'largest' or 'smallest'")
    tables = Tables(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = F.coalesce(normalise(text), F.lit("")) if normalise else text
    whole = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("data"))
    blocks = F.flatten(F.transform(_cut(F.col("data"), PIECE), lambda piece: _cut(piece, BLOCK)))

    def keyed(key: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
        """Names of the different blocks by their key, and texts with the keys of their blocks."""
        each = whole.select(F.explode(blocks).alias("block")).select(key(F.col("block")).alias("key"), "block")
        names = tables.stored(_named(each, "block").select("key", "name"), "block-names")
        heads = whole.select(F.monotonically_increasing_id().alias("row"), "id", F.unhex(F.sha2("data", 256)).alias("sha"), F.transform(blocks, key).alias("keys"))
        return names, tables.stored(heads, "texts")

    names, heads = keyed(lambda block: _key(block, key_bits))
    if not names.groupBy("key").count().where("count > 1").isEmpty():
        names, heads = keyed(lambda block: block)

    places = heads.select("row", F.size("keys").alias("k"), F.posexplode("keys").alias("at", "key"))
    now = tables.stored(places.join(names, "key").select("row", "k", "at", "name"), "names-0")
    done = now.where("k = 1").select("row", F.lit(0).alias("rounds"), "name")
    longest = heads.agg(F.max(F.size("keys"))).head()[0] or 1
    for rounds in range(1, (longest - 1).bit_length() + 1):
        side = lambda odd: F.max(F.when(F.col("at") % 2 == odd, F.col("name")))
        pairs = now.where("k > 1").groupBy("row", F.shiftright("at", 1).alias("at"))
        pairs = pairs.agg(F.shiftright(F.max("k") + 1, 1).alias("k"), side(0).alias("left"), F.coalesce(side(1), F.lit(-1)).alias("right"))
        names = tables.stored(_named(pairs.select("left", "right"), "left", "right"), "pair-names")
        now = tables.stored(pairs.join(names, ["left", "right"]).select("row", "k", "at", "name"), f"names-{rounds}")
        done = done.unionByName(now.where("k = 1").select("row", F.lit(rounds).alias("rounds"), "name"))

    members = tables.stored(heads.select("row", "id", "sha").join(done, "row"), "members")
    tables.clear(members)
    pick = F.max if keep == "largest" else F.min
    groups = members.groupBy("rounds", "name").agg(pick(F.struct("id", "row")).alias("best"), F.count("*").alias("group_size"))
    found = members.join(tables.stored(groups, "groups"), ["rounds", "name"])
    return found.select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )

"""Phrase collocations from FM-indexes over word ids, one index per shard of a language's words.

1. Each task gathers the words of its rows by language into shards of about SHARD_WORDS words, with a
   separator wherever a phrase may not go across, and writes for each shard its vocabulary with counts and
   two Burrows-Wheeler transforms, of the words and of the words in reverse. Suffixes are sorted by their
   first eight words, which is all that steps up to eight words need. The shards are stored once and never shuffled.
2. Upper bounds: the counts of pairs, then of triples of large pairs, are added up over all shards in hashed
   buckets. A phrase with a bucket below min_count is not frequent. One bit a bucket goes to all tasks: at most
   MOST_BUCKETS bits, whatever the input.
3. Exact counts: a shard extends the intervals of its words in both indexes at once, in turn to the right and to the
   left, down to the longest phrase, as long as all pairs and triples lie in large buckets. A task adds up the counts of
   its shards and reports phrases with their counts there. Spark sums them; those below min_count go.
4. Frequent phrases, their parts and their extensions by one word meet in equi-joins for the scores.

No phrase that reaches min_count is lost: its pairs and triples reach it too, and so do their buckets. Buckets only
save work; where they are too few for the input more phrases are counted and dropped. A common phrase costs one row a
task, of which there is one for TASK_WORDS words (or a core). Nothing that grows with the input is broadcast or collected.

Defined results: a null text is empty, a null language is 'und'. Repeated rows count each. A piece without
words has no phrase. Other columns are not read. An empty table gives an empty result. Texts of any length
go; a piece between separators is in one shard as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Tables, partitions, slices, stored

#: Words of a shard, and the bytes of text that are cut into words at once.
SHARD_WORDS = 1 << 22
CUT_BYTES = 1 << 24
#: Words for which there is a bucket, the most buckets (16 MB of bits), and the parts in which their counts are added up.
WORDS_A_BUCKET, MOST_BUCKETS, SEGMENTS = 8, 1 << 27, 64
#: A-Z lower-cased, what ends a piece as byte 255 (which UTF-8 never has), tabs as spaces.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\v\f\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\xff" * 10 + b" ")
SHARD_DDL = "shard long, lang string, words array<string>, counts array<long>, forward binary, reverse binary"
SHARD_TYPES = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
SHARD_NAMES = ["shard", "lang", "words", "counts", "forward", "reverse"]


def squeezed(x: np.ndarray) -> bytes:
    """32-bit integers, compressed byte by byte of each."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def restored(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def word_hashes(words: list[str]) -> np.ndarray:
    """A hash of every word of a vocabulary, 0 for the separator before it."""
    return np.array([0, *(xxhash.xxh3_64_intdigest(w.encode()) for w in words)], np.uint64)


def bucket_of(hashes: np.ndarray, phrases: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each phrase (rows of word numbers)."""
    x = hashes[phrases[:, 0]]
    for c in phrases.T[1:]:
        x = x * np.uint64(0x9E3779B97F4A7C15) + hashes[c]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


class _Ids(dict):
    """Numbers in order of first sight; 0 is the separator."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Shard:
    def __init__(self) -> None:
        self.ids, self.parts, self.size = _Ids({b"\xff": 0}), [np.zeros(1, np.int32)], 0

    def add(self, text: bytes) -> None:
        words = text.translate(_FOLD).replace(b"\xff", b" \xff ").split()
        self.parts += [np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
        self.size += len(words)

    def row(self, shard: int, lang: str) -> tuple | None:
        text = np.concatenate(self.parts)
        text = text[np.r_[True, (text[1:] != 0) | (text[:-1] != 0)]]  # runs of separators are one
        counts = np.bincount(text, minlength=len(self.ids))[1:]
        if not len(counts):
            return None
        words = [w.decode("utf-8", "replace") for w in self.ids][1:]
        return shard, lang, words, counts.tolist(), squeezed(transform(text)), squeezed(transform(text[::-1]))


def transform(text: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform of a circular text of small integers, in the order of its rotations' first eight."""
    rank = text.astype(np.int64)
    for step in (1, 2, 4):
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
        order = np.argsort(key, kind="stable")
        key = key[order]
        if step < 4:
            rank = np.empty(len(text), np.int64)
            rank[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    return text[order - 1]


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in parts of about CUT_BYTES, cut where a piece ends."""
    at = 0
    while len(text) - at > CUT_BYTES:
        found = next((i for i in range(at + CUT_BYTES, len(text)) if _FOLD[text[i]] == 255), len(text))
        yield text[at:found]
        at = found
    yield text[at:]


def _shards(text_col: str, lang_col: str, size: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, open_, made = TaskContext.get().partitionId() << 24, {}, 0

        def closed(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            row = open_.pop(lang).row(base + made, lang)
            made += 1
            if row:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, SHARD_TYPES, strict=True)], names=SHARD_NAMES)

        for batch in slices(batches):
            texts = batch.column(text_col).cast(pa.string()).cast(pa.binary()).to_pylist()
            for text, lang in zip(texts, batch.column(lang_col).to_pylist(), strict=True):
                for part in _pieces(text or b""):
                    shard = open_.setdefault(lang, _Shard())
                    shard.add(part)
                    if shard.size >= size:
                        yield from closed(lang)
            if sum(s.size for s in open_.values()) > 4 * size:  # very many languages
                yield from closed(max(open_, key=lambda k: open_[k].size))
        for lang in list(open_):
            yield from closed(lang)
        pa.default_memory_pool().release_unused()

    return make


class BiIndex:
    """Intervals of phrases in the index of a text and in that of its reverse, grown by one word at either end; arrays of phrases at once."""

    def __init__(self, forward: np.ndarray, reverse: np.ndarray, sigma: int) -> None:
        self.sigma, self.bwt = sigma, [forward, reverse]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(forward, minlength=sigma))])
        self.steps = []  # where the word before a row's suffix begins its own
        for b in self.bwt:
            step = np.empty(len(b), np.int32)
            step[np.argsort(b, kind="stable")] = np.arange(len(b), dtype=np.int32)
            self.steps.append(step)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, and their rows (start in the index, start in the reverse one, length)."""
        return np.arange(1, self.sigma)[:, None], np.stack([self.first[1:-1], self.first[1:-1], np.diff(self.first)[1:]], 1)

    def grown(self, phrases: np.ndarray, at: np.ndarray, left: bool, fits) -> tuple[np.ndarray, np.ndarray]:
        """All phrases longer by a word at one end for which fits(phrases), and their intervals. Works in slices of bounded size."""
        own, other = (0, 1) if left else (1, 0)
        ends = np.cumsum(at[:, 2])
        cuts = np.unique([0, *(np.searchsorted(ends, np.arange(SLICE, at[:, 2].sum(), SLICE)) + 1), len(at)])
        out = [(np.empty((0, phrases.shape[1] + 1), np.int64), np.empty((0, 3), np.int64))]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part, length = at[a:b], at[a:b, 2]
            who = np.repeat(np.arange(len(part)), length)
            rows = np.arange(len(who)) - np.repeat(np.cumsum(length) - length, length) + part[who, own]
            key, seen, count = np.unique(who * self.sigma + self.bwt[own][rows], return_index=True, return_counts=True)
            who, word = np.divmod(key, self.sigma)
            before = np.cumsum(count) - count  # of an interval's rows, those with smaller words
            before -= before[np.searchsorted(who, who)]
            new = np.empty((len(who), 3), np.int64)
            new[:, own], new[:, other], new[:, 2] = self.steps[own][rows[seen]], part[who, other] + before, count
            longer = np.column_stack([word, phrases[a:b][who]] if left else [phrases[a:b][who], word])
            keep = np.flatnonzero(word > 0)
            keep = keep[fits(longer[keep])]
            out.append((longer[keep], new[keep]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


#: Rows of intervals that are looked at together.
SLICE = 1 << 20


class _Filter:
    """Which phrases may be frequent, by the buckets of the pairs and triples at their ends."""

    def __init__(self, words: list[str], large: dict[int, np.ndarray]) -> None:
        self.hashes, self.large = word_hashes(words), large

    def __call__(self, phrases: np.ndarray) -> np.ndarray:
        ok = np.ones(len(phrases), bool)
        for size, many in self.large.items():
            if size <= phrases.shape[1]:
                for part in {0, phrases.shape[1] - size}:
                    rest = np.flatnonzero(ok)
                    ok[rest] = many[bucket_of(self.hashes, phrases[rest, part : part + size], len(many))]
        return ok


def _bits(large: dict[int, bytes]) -> dict[int, np.ndarray]:
    return {size: np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool) for size, b in large.items()}


def _opened(batches: Iterator[pa.RecordBatch], large: dict[int, bytes]) -> Iterator[tuple]:
    """(language, vocabulary with the separator first, index, filter) of each shard."""
    bits = _bits(large)
    for batch in batches:
        for i in range(batch.num_rows):
            words = ["", *batch["words"][i].as_py()]
            index = BiIndex(*[restored(batch[k][i].as_py()) for k in ("forward", "reverse")], len(words))
            yield batch["lang"][i].as_py(), words, index, _Filter(words[1:], bits)


def _phrases(index: BiIndex, fits: _Filter, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases of two words to the longest that pass, and their intervals: grown at the right and the left end in turn."""
    phrases, at = index.words()
    for size in range(2, longest + 1):
        phrases, at = index.grown(phrases, at, size % 2 == 1, fits)
        yield phrases, at


BUCKET_DDL = "segment int, places binary, counts binary"


def _segments(total: np.ndarray) -> pa.RecordBatch:
    parts = [(i, np.flatnonzero(x), x) for i, x in enumerate(np.split(total, SEGMENTS))]
    parts = [(i, np.diff(at, prepend=0), x[at]) for i, at, x in parts if len(at)]
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), *[pa.array([squeezed(p[k]) for p in parts], pa.binary()) for k in (1, 2)]], names=["segment", "places", "counts"])


def _bucket_counts(size: int, buckets: int, large: dict[int, bytes]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.uint32)
        for _, _, index, fits in _opened(batches, large):
            *_, (phrases, at) = _phrases(index, fits, size)
            where, back = np.unique(bucket_of(fits.hashes, phrases, buckets), return_inverse=True)
            total[where] = np.minimum(total[where] + np.bincount(back, at[:, 2], len(where)), 2**32 - 1)
        yield _segments(total)

    return each


def _added(buckets: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the counts of each segment, row by row."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                now = total.setdefault(batch["segment"][i].as_py(), np.zeros(buckets // SEGMENTS, np.uint32))
                at = np.cumsum(restored(batch["places"][i].as_py()))
                now[at] = np.minimum(now[at] + restored(batch["counts"][i].as_py()), 2**32 - 1)
        for segment, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "places": pa.array([squeezed(np.diff(at, prepend=0))]), "counts": pa.array([squeezed(counts[at])])})

    return each


def _large(shards: DataFrame, size: int, min_count: int, buckets: int, large: dict[int, bytes]) -> bytes:
    """One bit a bucket: whether the phrases of a size in it have min_count occurrences together."""
    some = shards.mapInArrow(_bucket_counts(size, buckets, large), BUCKET_DDL)
    some = some.withColumn("part", F.spark_partition_id() % int(partitions(shards.sparkSession) ** 0.5 + 1))
    some = some.repartition("segment", "part").drop("part").mapInArrow(_added(buckets), BUCKET_DDL).repartition("segment").mapInArrow(_added(buckets), BUCKET_DDL)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                flags = np.zeros(buckets // SEGMENTS, bool)
                flags[np.cumsum(restored(batch["places"][i].as_py()))] = restored(batch["counts"][i].as_py()) >= min_count
                yield pa.RecordBatch.from_pydict({"segment": batch["segment"].slice(i, 1), "bits": pa.array([np.packbits(flags).tobytes()])})

    rows = {r.segment: r.bits for r in some.mapInArrow(bits, "segment int, bits binary").collect()}  # a bit for each bucket
    return b"".join(rows.get(i, bytes(buckets // SEGMENTS // 8)) for i in range(SEGMENTS))


FOUND_DDL = "lang string, size int, phrase string, n long"
#: Words whose shards one task counts at least, where that leaves work for all cores, and phrases that it holds to add them up.
TASK_WORDS, HELD_PHRASES = 4 * SHARD_WORDS, 1 << 19


def _counted(longest: int, large: dict[int, bytes], most: int = HELD_PHRASES):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        total = 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by(["lang", "size", "phrase"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["lang", "size", "phrase", "n"])

        for lang, words, index, fits in _opened(batches, large):
            names = pa.array(words)
            for phrases, at in _phrases(index, fits, longest):
                texts = pc.binary_join_element_wise(*[names.take(pa.array(c)) for c in phrases.T], " ")
                size = pa.array(np.full(len(at), phrases.shape[1], np.int32))
                held.append(pa.table({"lang": pa.array([lang] * len(at), pa.string()), "size": size, "phrase": texts, "n": pa.array(at[:, 2])}))
                total += len(at)
            if total > most:  # the shards of a task share most of their phrases
                held = [summed()]
                total = held[0].num_rows
                if total > most // 2:
                    yield from held.pop().combine_chunks().to_batches(max_chunksize=1 << 16)
                    total = 0
        if held:
            yield from summed().combine_chunks().to_batches(max_chunksize=1 << 16)
        pa.default_memory_pool().release_unused()

    return each


def phrase_counts(
    docs: DataFrame, longest: int = 5, min_count: int = 100, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS, buckets: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of up to longest words with f >= min_count, and (lang, total) words of each language.

    buckets: a power of two from 512 on; by default one for WORDS_A_BUCKET words.
    """
    if not 2 <= longest <= 8:
        raise ValueError("phrases have 2 to 8 words")
    tables = Tables(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    shards = tables.stored(rows.mapInArrow(_shards("text", "lang", shard_words), SHARD_DDL), "shards")
    seen = shards.select("lang", F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))).alias("w")).select("lang", "w.word", "w.n")
    words = tables.stored(seen.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    totals = tables.stored(words.groupBy("lang").agg(F.sum("f").alias("total")), "totals")
    frequent = tables.stored(words.where(F.col("f") >= min_count).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f"), "phrases")

    everything = int(totals.agg(F.sum("total")).head()[0] or 0)
    buckets = buckets or min(MOST_BUCKETS, max(1 << 16, 1 << (everything // WORDS_A_BUCKET).bit_length()))
    if buckets < 8 * SEGMENTS or buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two, 512 at least")
    index, large = shards.select("lang", "words", "forward", "reverse"), {}
    for size in range(2, min(3, longest) + 1):
        large[size] = _large(index, size, min_count, buckets, dict(large))
    gathered = index.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, everything // TASK_WORDS + 1))
    more = gathered.mapInArrow(_counted(longest, large), FOUND_DDL).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    more = tables.stored(more.select("lang", "phrase", "size", "f"), "phrases")
    tables.clear(totals, frequent, more)
    return frequent.unionByName(more), totals


def floor_ratio(above: list, below: list) -> Column:
    """The product of up to three integers over that of two, rounded down, in decimals of 38 digits."""

    def product(factors: list) -> Column:
        out = F.lit(1).cast("decimal(38,0)")
        for f in factors:  # no factor has more than 19 digits, and the first two of three no more either
            out = (out.cast("decimal(19,0)") * (F.col(f) if isinstance(f, str) else F.lit(f)).cast("decimal(19,0)")).cast("decimal(38,0)")
        return out

    return F.call_function("div", product(above), product(below))


def _best(rows: DataFrame, top: int, salts: int) -> DataFrame:
    """The first rows of each language with their rank: first within salted parts of a language, then of what is left."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("part")


def collocations(docs: DataFrame, longest: int = 5, min_count: int = 100, top: int = 2000, scale: int = 1000, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS, buckets: int | None = None) -> DataFrame:
    """The first phrases of each language by score: lang, rank, phrase, size, a, cut, l, r, n, score.

    a: occurrences of the phrase; cut: the words before its weakest cut; l, r: occurrences of the parts there;
    n: the language's words; score: floor(scale * a * n / (l * r)). A phrase goes if a longer one around it is as frequent.
    """
    found, totals = phrase_counts(docs, longest, min_count, text_col, lang_col, shard_words, buckets)
    phrases = found.where("size > 1")
    # A phrase around another of the same count: so is the one that is longer by one word, as counts only fall.
    first = F.expr("substring_index(phrase, ' ', size - 1)")
    last = F.expr("substring_index(phrase, ' ', 1 - size)")
    around = phrases.where("size > 2").select("lang", F.explode(F.array(first, last)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("wider"))
    alone = stored(phrases.join(around, ["lang", "phrase"], "left").where("wider is null or wider < f").drop("wider"), "phrases")

    cuts = alone.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', cut)").alias("head"), F.expr("substring_index(phrase, ' ', cut - size)").alias("tail"))
    counts = found.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    cuts = cuts.join(counts.withColumnsRenamed({"part": "head", "part_f": "l"}), ["lang", "head"])
    cuts = cuts.join(counts.withColumnsRenamed({"part": "tail", "part_f": "r"}), ["lang", "tail"]).join(totals, "lang")
    cuts = cuts.withColumn("score", floor_ratio([scale, "f", "total"], ["l", "r"]))
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "size", "f", "total")).alias("w"))
    rows = weakest.select("lang", "phrase", "w.size", F.col("w.f").alias("a"), "w.cut", "w.l", "w.r", F.col("w.total").alias("n"), "w.score")
    return _best(rows, top, 4 * partitions(docs.sparkSession)).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "size", "a", "cut", "l", "r", "n", "score")

"""A corpus pipeline: quality rules, near-duplicates, decontamination, secret scans, packing.

run(spark, sf_dir) applies STAGES to the documents table in order; each stage's rows are written as
Parquet in the shared folder and read again as the next stage's docs. All stages but the last keep
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlight.llm.common import Tables, scratch, table
from fieldlight.llm.decontaminate import decontaminate
from fieldlight.llm.near_copies import near_copies
from fieldlight.llm.packing import pack, with_crc
from fieldlight.llm.quality import quality_rules
from fieldlight.llm.queries import tokenizer_path
from fieldlight.llm.secrets import redacted


def _wrapped(docs: DataFrame) -> DataFrame:
    """All but the text as one column beside doc_id and text, so that no column of documents clashes with an operator's."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_doc"), "doc_id", "text")


def _unwrapped(rows: DataFrame, columns: list[str], **new) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else new.get(c, F.col("_doc")[c]).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules or the learned list reject go. A null text has no words and goes."""
    judged = quality_rules(_wrapped(docs), table(spark, sf_dir, "labels"))
    return _unwrapped(judged.where("kept"), docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (SimHash by pivot tables; five-word shingles, similarity 0.8) stays: that with the least doc_id, once.

    Of documents without an id only copies of each other, and near copies of one with an id, go.
    """
    groups = near_copies(docs.select("doc_id", "text"), width=5, least=0.8)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    rows = _wrapped(docs).join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").withColumn("_text", F.sha2("text", 256))
    return _unwrapped(rows.dropDuplicates(["doc_id", "_text"]), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. A null text has none; repeated rows go or stay together."""
    found = decontaminate(_wrapped(docs), table(spark, sf_dir, "benchmark"))
    return _unwrapped(found.where("n_hit = 0"), docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; n_chars follows the text. A null text stays null; repeated rows stay repeated."""
    return _unwrapped(redacted(_wrapped(docs)), docs.columns, n_chars=F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. A null text is its end token alone; repeated rows are packed each on their own."""
    pieces = pack(docs.select("doc_id", "text"), tokenizer_path(), special=True)
    return with_crc(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("dedup", dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept = table(spark, sf_dir, "documents"), Tables(spark)
    try:
        for name, stage in STAGES[:-1]:
            with scratch(spark):  # what the stage's operators write on their way
                rows = stage(spark, docs, sf_dir)
                docs = kept.stored(rows, name)
            kept.clear(docs)
        return STAGES[-1][1](spark, docs, sf_dir)
    except BaseException:
        kept.clear()
        raise


#: Fingerprints (XXH64) and learned rules have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None

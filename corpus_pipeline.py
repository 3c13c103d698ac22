"""The corpus pipeline: five stages over documents, each working on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxweave.llm.common import crc_of_id, stored, table
from rxweave.llm.decontaminate import overlaps
from rxweave.llm.line_dedup import dedup_lines
from rxweave.llm.packing import pack
from rxweave.llm.quality import score_quality
from rxweave.llm.queries import QUALITY_CUT
from rxweave.llm.simhash import similar_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the cut go; the network learns from labelled ids outside the held-out fold.

    Null and empty texts have a score like any other, null ids are scored and never learned from, repeated rows are kept or
    go together, other columns are left out, and an empty table stays empty.
    """
    scored = score_quality(docs, table(spark, sf_dir, "labels"), crc_of_id() % 5 != 0, keep=("text", "lang", "source", "n_chars"))
    return scored.where(F.col("score") >= QUALITY_CUT).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go; so does a document of which nothing else was left. n_chars is counted again.

    Null and empty texts stay, a null id is later than any other, repeated rows (id and text) are treated alike and keep
    their lines, other columns are left out, and an empty table stays empty.
    """
    cut = dedup_lines(docs, keep=("lang", "source")).where("n_removed = 0 or n_removed < n_lines")
    return cut.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that are linked at five-word shingles and a similarity of 0.8, the one with the smallest id stays.

    Null text is empty, and texts without words are linked to each other. In a group whose ids are all null one text stays; of
    repeated rows (id and text) one stays, whichever its other columns. An empty table stays empty.
    """
    groups = similar_documents(docs).select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"), (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("node") == F.col("leader"))).alias("_stays"))
    counted = groups.groupBy("_id", "_node", "_stays").agg(F.count("*").alias("_n"))
    odd = stored(counted.where("NOT _stays OR _n > 1"), "not-as-they-are")  # what goes, and what is there several times
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_node"))
    hashed = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("_hash"))
    once = hashed.join(odd.where("_stays"), same, "left_semi").dropDuplicates(["doc_id", "_hash"])
    return hashed.join(odd, same, "left_anti").unionByName(once).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go.

    Null and empty texts stay, documents with a null id are told apart by their texts, repeated rows stay or go together,
    other columns are left out, and an empty table stays empty.
    """
    leaks = overlaps(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"))
    leaks = stored(leaks.distinct(), "leaks")
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th")), "left_anti").select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left is packed into sequences of at most 2048 tokens.

    Null and empty texts are the end token alone, null ids and repeated rows are packed like any other, other columns are
    left out, and an empty table gives no rows.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", packing),
]
#: A trained network and a fitted plan are not SQL; every stage is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is written as Parquet for the next."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs, f"stage{n}")
    return docs

"""A corpus from raw documents to packed training sequences: five stages, each a decision that the next one sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm import chosen_path, language_id, line_dedup, mixing, packing
from strataforge.llm.common import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, or without text, go; where no language can be learned, all others stay without one.

    Null texts have no letter; equal texts share their fate; rows that repeat an id are judged each; null ids, languages and
    sources stay; an empty table gives an empty one; columns of any name pass.
    """
    letters = (F.col("score") > 0) | F.col("text").rlike(r"\p{L}")
    return language_id.identify(docs).where(letters).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; a document of which nothing stays goes.

    Documents are ids: rows that repeat one, and rows without one, count as one document each time a line is counted. A null
    text is one empty line. An empty table gives an empty one; columns of any name but n_lines, n_dropped and kept_text pass.
    """
    kept = line_dedup.dedup_lines(docs)
    some = F.col("n_dropped") < F.col("n_lines")
    return kept.where(some).withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays.

    Ties of rows that share an id, or have none, are broken by their sets and texts, so one row stays. Texts without a word are
    in no class and stay. An empty table gives an empty one; columns of any name pass.
    """
    return chosen_path.first_of_each_class(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes; what it takes twice is there twice.

    Null and empty texts give nothing; a null source is a source; rows that repeat an id are rows of their own. n_chars is
    that of the words taken. An empty table gives an empty one; columns of any name pass.
    """
    return mixing.mixed_rows(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences without padding, under limits on tokens, pieces and tokens of answers (even lines).

    Null and empty texts are the end id alone; rows that repeat an id are packed each; null ids stay null; an empty table gives
    an empty one; columns but doc_id and text, whatever their names, are not read.
    """
    return packing.pack(docs)


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("mixing sources", mix), ("packing", pack)]

#: Seeded block selection, set similarity and token ids have no SQL form; the stages are held against brute force in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES:
        path = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

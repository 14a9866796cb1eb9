"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next stage's docs.  All
stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from histlens.llm.common import documents, remove, work_path
from histlens.llm.line_dedup import LineIndex, clean_lines
from histlens.llm.mixing import mix
from histlens.llm.packing import file_order, packed
from histlens.llm.quality import only_good
from histlens.llm.similar import without_near_duplicates
from histlens.llm.tokens import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and empty texts among them; an empty table stays empty."""
    return only_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose key is in ten or more documents go; every document stays, if with an empty text; a null text stays null."""
    return clean_lines(docs, LineIndex.of(docs, least_documents=10))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: five-word shingles, similarity 0.8 or more.

    Texts without words are one class; a repeated row stays once; an empty table stays empty.
    """
    return without_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in curriculum order.

    Texts without words come along in their turn, for no words; a null source is the last source; an empty table stays empty.
    """
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; those of earlier stretches of the curriculum have lower ids.

    A row has its piece's token ids, so sequences are put together from this table
    alone: the texts were cleaned and repeated on the way.  The curriculum's order
    is that of the files which mixing wrote; files of another making raise.  A null
    text is a document of just the end id; equal rows are documents of their own; an
    empty table gives no sequence.
    """
    return packed(docs, tokenizer_path("byte_bpe_50k.json"), end=0, capacity=2048, order=file_order(docs), keep_ids=True)


STAGES = [("quality", quality), ("lines", lines), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither fingerprints nor packing; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; a stage's table goes when the next one's is written, or when a stage fails."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = work_path(spark, name)
        try:
            stage(spark, docs, sf_dir).write.parquet(path)
        except BaseException:
            remove(spark, path)
            raise
        finally:
            if before is not None:
                remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs

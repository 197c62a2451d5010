"""The corpus pipeline: filter by quality, remove exact and near copies and repeated passages, pack.

Each stage is written as Parquet in the shared folder and read again as the next one's documents; what it no longer needs is deleted.
Before each, executors return the heap that the last one has grown.

Null and empty texts are documents like any other: the classifier judges them as empty, all of them are exact copies of each other, and one
of them is packed as an end token, if it stays. A null identifier comes after all others, so such a row stays unless a copy has an identifier.
Rows that repeat an identifier and a text are copies. Extra columns stay whatever their names are. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomql.llm.exact_dedup import exact_dedup
from loomql.llm.near_copies import drop_near
from loomql.llm.packing import packed_documents
from loomql.llm.quality import keep_quality
from loomql.llm.shared import discard, give_back_heap, read_table, settled
from loomql.llm.substring_dedup import substring_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def afresh(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back_heap(spark)
        return stage(spark, docs, sf_dir)

    return run


@afresh
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels that aren't held out, scores 0.5 or more."""
    return keep_quality(docs, read_table(spark, sf_dir, "labels"))


@afresh
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the one with the smallest doc_id."""
    return exact_dedup(docs)


@afresh
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts linked by 5-word shingles (Jaccard 0.8 or more), the document with the smallest doc_id."""
    return drop_near(docs)


@afresh
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 20-word passages that occur earlier; n_chars, where there is one, follows the texts."""
    cut = substring_dedup(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@afresh
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its tokens' place in the document and in a sequence."""
    return packed_documents(docs)


STAGES = [
    ("quality", quality_filter),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("packing", pack_sequences),
]
#: SQL expresses neither the classifier nor the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the whole of documents."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, last = settled(lambda: stage(spark, docs, sf_dir), name.replace(" ", "-")), before  # noqa: B023
        before = docs
        if last is not None:
            discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline of five of the operators, each stage on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablescope.llm import line_dedup, mixing, near_dedup, packing, quality
from tablescope.llm.common import python_path, table, written


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, does not reject.

    A null text is judged as an empty one; repeated rows stay or go together; a score of one half stays; without labels all
    stay; no documents, none.
    """
    python_path(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines that stand elsewhere before.

    A null text stays null, a text all of whose chunks are repeated becomes empty; rows equal in id and text are one place
    and stay equal; the first place is that of the smallest id, null last; no documents, none.
    """
    python_path(spark)
    return line_dedup.dedup_lines(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest id, null last.

    Texts without words, null ones too, are one class; of repeated rows one stays; no documents, none.
    """
    python_path(spark)
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target and its key take it.

    A null source is a source; null and empty texts have no size and do not count towards a target; repeated rows share what
    they take; equal keys follow the id, then the size; no documents, none.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places.

    A null or empty text is its end id alone; repeated rows are packed one by one; pieces of one length take places in the
    order of their ids; no documents, no pieces.
    """
    python_path(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", reject_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has no classifier, signatures, exponential keys of the same rounding or packing: the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

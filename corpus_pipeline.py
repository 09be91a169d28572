"""Documents to packed training sequences: quality rules, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents.

Odd input, stage by stage.  Null and empty texts have no words: the quality rules drop them, as all with few words; by
themselves the near-duplicates would keep each of them, the mix would take nothing of them, and packing would give each
a piece with the end id alone.  Very long texts are taken whole by every stage.  Repeated rows are copies: one of them
stays after the near-duplicates.  A null doc_id, lang or source is a value like any other; of copies, one with a doc_id
stays, the smallest.  Ties go to the smallest doc_id, the earlier source, or a seeded hash.  An empty table passes
through all stages.  Columns beyond those of documents, whatever their names, pass through all but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trovex.llm.common import stored, table
from trovex.llm.jaccard_join import Rule, one_of_each
from trovex.llm.mixing import chosen_texts
from trovex.llm.packing import packed
from trovex.llm.quality import filtered


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest keep."""
    return filtered(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with word shingles of five alike to 0.8 or more."""
    return one_of_each(docs, Rule(5, 80))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that each source's blocks give, a row for each pass over a document."""
    return chosen_texts(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents and their places in sequences of 1024 tokens."""
    return packed(docs, "byte_bpe_50k.json", end_id=2, capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("source mix", source_mix),
    ("packing", sequences),
]

#: The stages learn, hash and search in ways that SQL does not express; the tests run each against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to packed training sequences: five stages, each one of the corpus operators.

Every stage reads what its predecessor wrote. All but the last return the columns of ``documents``.

Null and empty texts, and texts without letters, have no language and go in the first stage. Rows that share an id are
rows of their own; of rows that share id and text, the third stage leaves one. A null id comes after all others. Ties
go to the smallest id. An empty table gives an empty result; other columns than the id, the text, the language and the
number of characters are handed on as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from diurna.llm import decontamination, langid, line_dedup, packing, simhash_dedup
from diurna.llm.common import table, written

def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no language with calibrated confidence, go."""
    model = langid.train(docs.where(langid.learned_from("doc_id", 4, 2)))
    return langid.keep_accepted(docs, model)


def line_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of three documents or more stay in the last of them only."""
    return line_dedup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that have four fifths of their five-word shingles in common, one stays."""
    return simhash_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its place in a sequence."""
    return packing.packing_report(docs)


STAGES = [("language ID", language_id), ("line dedup", line_dedup_), ("near dedup", near_dedup), ("decontamination", decontaminate), ("packing", pack)]
#: Languages, fingerprints and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

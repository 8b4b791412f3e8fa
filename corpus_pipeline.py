"""A pipeline over documents: quality rules, near copies, personal data, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagesieve.llm import cutting_stock, disclosure, domain_mix, line_rules, signature_tree_join
from pagesieve.llm.common import drop_stages_since, stage, stages_written, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that are too frequent on their host.

    Null and empty texts have no words and go; a null source is the host ''; rows without doc_id are told apart by their texts.
    Repeated rows stay repeated; extra columns stay as they are."""
    return line_rules.apply_rules(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class under five-word shingles and a similarity of 0.8: that with the smallest doc_id.

    Null, empty and blank texts are classes of their own; of rows that repeat a doc_id one stays; rows without doc_id stay all."""
    return signature_tree_join.keep_representatives(docs, width=5, percent=80, cover="minhash")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what discloses them replaced.

    Null and empty texts stay; repeated rows count once where terms are rated, and all are changed alike."""
    return disclosure.sanitise(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned to the target weights of their domains; those of the main domain all stay.

    Null and empty texts have no tokens and stay; labels without a document, or null, are left out. Repeated rows share their fate."""
    return domain_mix.thin(docs, table(spark, sf_dir, "labels"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; null and empty texts give the one closing id, repeated rows are packed each."""
    return cutting_stock.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_copies", near_copies), ("personal_data", personal_data), ("source_mix", source_mix), ("packing", packed)]

#: Trained models and tokenization are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again by the next. What a stage and its predecessor wrote goes when it has ended."""
    docs, mark = table(spark, sf_dir, "documents"), stages_written()
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
        drop_stages_since(spark, mark, but=1)
    return STAGES[-1][1](spark, docs, sf_dir)

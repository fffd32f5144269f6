"""A corpus pipeline: toxic documents go, repeated lines go, near copies go, sources are mixed, texts become tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, lines, mixing, simhash, toxicity
from tidemark.llm.common import stored, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the table labels, doesn't reject.

    Null, empty and wordless texts get what the biases give; every row is judged by itself, repeated or not. Without labels nothing goes.
    """
    chain = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, chain)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that equal the first of their class in the whole corpus or are within two edits of it.

    Null texts stay null, documents that lose every line stay with an empty text; rows of one doc_id share their line numbers.
    """
    return lines.drop_duplicate_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near duplicates: SimHash blocks and MinHash bands propose, five-word shingle sets decide.

    Null, empty and wordless texts are one group; rows that share the doc_id that stays all stay; a group without any doc_id stays.
    """
    return simhash.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources come near their targets; a null source is one of its own, null texts have size 0."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and the digest of what they decode to; null and empty texts have no ids. One row for each row."""
    return bpe.tokenized(docs, ["doc_id", "lang", "source", "n_chars"])


STAGES = [("toxicity", toxic), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("bpe", tokens)]
#: The stages' models and components can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each one's rows written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

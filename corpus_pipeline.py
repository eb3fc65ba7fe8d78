"""Corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, tokens."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import bpe, contamination, jaccard, lines, quality, scratch

_run = threading.local()  # a thread's stages follow each other; other threads have tables of their own


def _stage(operator):
    """A stage that first removes what this thread's stage before it left in the shared folder: its result was written since."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.release(spark, getattr(_run, "before", []))
        with scratch.noted() as paths:
            out = operator(spark, docs, sf_dir)
        _run.before = paths
        return out

    return run


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep.

    Null and empty texts have no words and go; a null host is judged by its own text; repeated rows are judged alike; an
    empty table stays empty; a text is one row however long; extra columns pass through under any name but ``_row``.
    """
    return quality.judge(docs).where("kept").select("_row.*")


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; n_chars stays that of the input text.

    Null texts and null ids pass as they are; of equal lines the first by (doc_id, line) stays; rows that repeat a doc_id do
    not remove each other's lines; an empty table stays empty; a very long text is one row of its lines.
    """
    return lines.dedup_lines(docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near duplicates.

    Null texts are classes of their own, null ids stay; rows that repeat a kept id all stay; an empty table stays empty; a
    very long text is one task's work.
    """
    return jaccard.keep_one(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates.

    Null or empty texts and items match nothing, null ids stay, repeated rows go or stay together, empty tables of either
    kind change nothing; a very long text is searched whole.
    """
    return contamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of its ids and of the text decoded from them.

    A null text is encoded as an empty one; ids pass as they are, null or repeated; an empty table stays empty.
    """
    return bpe.encode_texts(docs)


STAGES = [
    ("quality rules", _stage(_quality)),
    ("line dedup", _stage(_lines)),
    ("near duplicates", _stage(_near_duplicates)),
    ("decontamination", _stage(_decontamination)),
    ("tokens", _stage(_tokens)),
]

#: Connected near-duplicate classes, edit distance and byte-pair merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        last, path = path, scratch.new_path(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            scratch.release(spark, [last])
    return docs

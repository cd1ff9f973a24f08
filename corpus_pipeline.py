"""Corpus pipeline: from ``documents`` to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The filtering
stages return the columns of ``documents``; the last returns where each piece of each kept document
goes. Stages fit what they need on their own input.

Null, empty and very long texts, rows without id, repeated rows, empty tables and further columns are
as the operators' modules define them: null, empty and letterless texts go in the language stage; rows
without id go through all stages like others (each for itself in the near-duplicate stage); of rows
that share an id one stays there; further columns, also of clashing names, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from likeness.llm.catalog import BYTE_BPE
from likeness.llm.common import table
from likeness.sources.scratch import Scratch
from likeness.llm.language import keep_identified
from likeness.llm.near_duplicates import keep_one_of_each
from likeness.llm.packing import pack_documents
from likeness.llm.toxicity import keep_ordinary


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models score as toxic go."""
    return keep_ordinary(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letters, or no language stands out) go."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles the first stays."""
    return keep_one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' tokens, packed into sequences of 2048."""
    return pack_documents(docs, BYTE_BPE)


STAGES = [("toxicity", toxicity), ("language ID", language), ("MinHash near-dedup", near_duplicates), ("best-fit packing", packing)]

#: Learned models and tokenizers aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each keeps is written to the shared folder for the next."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A pipeline that makes a training corpus from documents: each stage's rows are written and read as the next one's input.

Every stage takes an empty table (and returns one), null doc_ids, texts, langs
and sources, texts of any length, repeated rows, and columns of any further
name, which all but the last stage pass through; what each makes of them is
stated there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.decontaminate import contamination
from tidewire.llm.minhash import one_of_each
from tidewire.llm.mixing import poisson_mix
from tidewire.llm.queries import table
from tidewire.llm.scratch import written
from tidewire.llm.sharding import shard_table
from tidewire.llm.toxicity import toxicity


def keeping(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs`` in the rows that ``operator`` returns; all but those it reads have other names meanwhile, so none is replaced."""
    read = {"doc_id", "text", "source"}
    away = {c: c if c in read else f"_own_{i}" for i, c in enumerate(docs.columns)}
    out = operator(docs.select(*[F.col(f"`{c}`").alias(a) for c, a in away.items()]))
    return out.select(*[F.col(a).alias(c) for c, a in away.items()])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Null and empty texts are not toxic; equal texts share their fate; without labels of both kinds nothing goes, unless all are toxic."""
    return keeping(docs, lambda rows: toxicity(rows, table(spark, sf_dir, "labels")).where("toxicity < 0.5"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest doc_id, one row of it.

    Shingles have five words, as near-duplicate stages without a contract of
    their own have; two edited words in a short text break ten of them, so fewer
    edited copies reach 0.8 than with the two words of op8. Texts without words,
    and rows without doc_id, stay. A text like no other stays, also if another
    text has the same doc_id.
    """
    return keeping(docs, lambda rows: one_of_each(rows, n=5, percent=80))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a test item go. Null and empty texts hold none; null, empty and repeated items do no harm; without items nothing goes."""
    return keeping(docs, lambda rows: contamination(rows, table(spark, sf_dir, "benchmark")).where("not contaminated"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights; a document stays as often as its count says. A null source is a source; equal rows, and rows of a source without doc_id, share a count."""
    return keeping(docs, poisson_mix)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row; repeated rows get slots of their own, in one shard where their group fits. Null texts have no checksum and a size of 16."""
    return shard_table(docs, 40).select("doc_id", "source", "size", "text_crc32", "shard", "slot")


STAGES = [("toxicity", toxic), ("near_duplicates", near_copies), ("decontamination", benchmark_leaks), ("mixing", mixed), ("sharding", shards)]

#: Near-duplicate hashing, kernels and alignment have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; tables of all stages lie in the shared folder until its owner clears it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs

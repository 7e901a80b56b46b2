"""The registered queries of this subpackage: thin applications of its operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


def op7_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import HELD_OUT, toxicity

    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.selectExpr("doc_id", f"coalesce({HELD_OUT}, false) as held_out", "toxicity as score", "cast(toxicity >= 0.5 as int) as predicted")


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import poisson_mix

    mixed = poisson_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", F.col("replica").cast("long").alias("replica"), "text")


def op3_proportional_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_table

    out = shard_table(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "source")


def op2_seeded_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")


def op1_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import HELD_OUT, identify, train

    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multiindex import neighbours

    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op4_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .surrogates import pseudonymised

    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .perplexity import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op6_licence_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths; they are laid out as source / thousands / hundreds of doc_id / doc_id."""
    from .licences import licensed

    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.expr("cast(doc_id div 1000 as string)"), F.expr("cast(doc_id div 100 as string)"), F.col("doc_id").cast("string"))
    return licensed(table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op12_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathlib import Path

    import public_tokenizers

    from .packing import packed

    definition = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    found = packed(table(spark, sf_dir, "documents"), definition, end=1).pieces
    return found.select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document, by the checksum of its id, is made periodic from a word of its own on before the runs are sought; without a doc_id, none is."""
    from .periodic import periodic_runs

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    docs = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("w", F.when(F.expr("h % 10 = 0"), words)).withColumn("n", F.size("w"))
    docs = docs.withColumn("a", F.expr("if(n > 0, (h div 10) % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    planted = F.expr("concat_ws(' ', transform(sequence(0, n - 1), i -> w[int(if(i < a, i, a + (i - a) % p))]))")
    found = periodic_runs(docs.select("doc_id", F.when(F.expr("n > 0"), planted).otherwise(F.col("text")).alias("text")))
    # The longest run, then the first, then that of the smallest period.
    found = found.withColumn("best", F.expr("array_min(transform(runs, r -> struct(-r.length as l, r.start as start, r.period as period)))"))
    lines = F.expr(r"concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * -best.l div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return ORACLES

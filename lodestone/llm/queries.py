"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import BytePairEncoding
from lodestone.llm.decontamination import Decontamination
from lodestone.llm.fill_middle import FillInMiddle
from lodestone.llm.importance import ImportanceResampling
from lodestone.llm.jaccard_join import JaccardJoin
from lodestone.llm.licenses import scan_licenses
from lodestone.llm.metric_search import MetricSearch
from lodestone.llm.near_dedup import NearDedup
from lodestone.llm.packing import Packing
from lodestone.llm.quality import QualityClassifier
from lodestone.llm.secrets import SecretScan
from lodestone.llm.substring_dedup import SubstringDedup
from lodestone.llm.url_filters import RULES, filter_urls
from lodestone.session import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = SubstringDedup(window=13).run(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QualityClassifier().run(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MetricSearch(k=10).run(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def tokenizer_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def encoded(docs: DataFrame) -> DataFrame:
    bpe = BytePairEncoding(tokenizer_path())
    out = bpe.round_trip(docs)
    decimal = F.replace(F.btrim(F.col("ids").cast("string"), F.lit("[]")), F.lit(", "), F.lit(","))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(decimal, "utf-8"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op7_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Packing(tokenizer_path(), size=2048).run(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Decontamination().run(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tag")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDedup(width=5, percent=75).run(table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = SecretScan().run(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.length("value").alias("n_chars"), F.sha2(F.encode("value", "utf-8"), 256).alias("value_sha256"), "score")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw = ImportanceResampling(orders=3, buckets=10_000, percent=5, least_words=20, seed=42)
    out = draw.run(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(width=5, percent=80).run(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fim = FillInMiddle(seed=1, plain_percent=10, spm_percent=20)
    out = fim.restore(fim.run(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256).alias(f"{c}_sha256")
    return out.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), digest("output"), digest("restored"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_license_scans": op4_license_scans,
    "op5_url_filters": op5_url_filters,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_token_packing": op7_token_packing,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_secret_scans": op10_secret_scans,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_fill_in_middle": op13_fill_in_middle,
}

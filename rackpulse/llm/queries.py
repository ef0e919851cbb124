"""Registered queries of the training-data operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.llm import (
    decontamination,
    merkle,
    ngram_join,
    packing_ga,
    perspectives,
    pseudonyms,
    quality_gam,
    spelling,
    token_counts,
    token_orc,
    toxicity,
    url_filters,
    vp_search,
)
from rackpulse.session import materialise, work_path

SEQUENCE_LENGTH = 4096
QUALITY_AT_LEAST = 0.3
#: One is exact search.
SEARCH_FACTOR = 1.0
#: Key of the registered runs; a real corpus takes its own from the outside.
PSEUDONYM_KEY = "corpus-pseudonyms"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def not_held_out(parts: int, held: int) -> Column:
    """Rows that a fit may learn from: crc32 of the id as text, modulo ``parts``, is not ``held``."""
    return ~held_out(parts, held)


def held_out(parts: int, held: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == held


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"), "toxic", not_held_out(3, 1))
    return toxicity.score_documents(docs, model).select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.shingle_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op4_vantage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index = vp_search.build_index(vectors)
    return vp_search.search(index, vectors.filter(F.col("vec_id") % 20 == 0), k=20, factor=SEARCH_FACTOR)


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_path(spark, "token-orc")
    token_orc.write_tokens(table(spark, sf_dir, "documents"), out, end_id=2)
    return token_orc.digest_tokens(spark, out)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_gam.fit_on(docs, table(spark, sf_dir, "labels"), "quality", not_held_out(5, 0))
    return quality_gam.score_documents(docs, model, with_text=False).select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= QUALITY_AT_LEAST).cast("int").alias("predicted")
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing_ga.token_pieces(table(spark, sf_dir, "documents"), SEQUENCE_LENGTH, end_id=1)
    return packing_ga.pack(pieces, SEQUENCE_LENGTH, ["doc_id", "piece"])


def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = perspectives.render_perspectives(table(spark, sf_dir, "conversations"))
    return rendered.withColumn("mask", perspectives.mask_text(rendered["mask"]))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = decontamination.benchmark_windows(table(spark, sf_dir, "benchmark"))
    windows = materialise(windows, "windows")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_passages(docs, windows, with_text=False)
    hits = decontamination.items_found(found.drop("spans"), windows)
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


#: Host, path and verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op11_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), rules)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, more).otherwise(F.col("n_chars").cast("string"))
    return merkle.manifest(table(spark, sf_dir, "documents"), {"n_chars": changed})


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_token_counts": op3_token_counts,
    "op4_vantage_search": op4_vantage_search,
    "op5_token_orc": op5_token_orc,
    "op6_quality": op6_quality,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_chat_perspectives": op8_chat_perspectives,
    "op9_decontamination": op9_decontamination,
    "op10_pseudonyms": op10_pseudonyms,
    "op11_redirect_equivalence": op11_redirect_equivalence,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES = {
    "op2_ngram_jaccard": ngram_join.ORACLE,
    "op4_vantage_search": vp_search.ORACLE,
    "op8_chat_perspectives": perspectives.ORACLE,
    "op9_decontamination": decontamination.ORACLE,
    "op11_redirect_equivalence": url_filters.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}

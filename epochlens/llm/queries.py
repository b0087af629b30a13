"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.llm import decontaminate, filteraudit, itq, langid, linededup, mixing, neardup, pii, productcodes, suffixtree, tokens, toxicity, urls
from epochlens.llm.common import crc_bucket, shared_dir, table


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))


def op4_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.systematic_mix(docs)
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


#: The rules that op1's contract fixes: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, table(spark, sf_dir, "labels"), URL_RULES).withColumnRenamed("id", "page_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    counted = tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), cache)
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predict_languages(docs).withColumnRenamed("id", "doc_id")


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = suffixtree.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.withColumnRenamed("id", "doc_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"), F.col("toxic_evidence").alias("evidence"))


def op8_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    best = found.groupBy("id", "item").agg(F.max(F.struct("shared_shingles", "item_shingles", "item_copies", "containment")).alias("x"))
    return best.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "x.item_copies", "x.item_shingles", "x.shared_shingles", "x.containment")


def op9_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.embedding_links(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, key="surrogates-1")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filteraudit.filter_audit(docs, table(spark, sf_dir, "labels"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least_docs=10, least_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return productcodes.compress(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_templates, op2_token_counts, op3_near_duplicates, op4_systematic_mix, op5_language, op6_suffix_tree, op7_toxicity, op8_contaminated, op9_embedding_links, op10_surrogates, op11_filter_audit, op12_line_dedup, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op4_systematic_mix": mixing.MIX_SQL, "op8_contaminated": decontaminate.DECONTAMINATE_SQL, "op11_filter_audit": filteraudit.AUDIT_SQL, "op12_line_dedup": linededup.LINES_SQL, "op13_vector_codes": productcodes.CODES_SQL}

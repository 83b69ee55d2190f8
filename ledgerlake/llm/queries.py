"""Registered queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, collocations, decontaminate, exact_dedup, html_extract, jaccard_join, language_id, licenses, mixing, sharding, substring_dedup, toxicity, vector_links
from .common import read_table, text_of

N_SHARDS = 24


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs)
    names = F.array_sort(F.array_distinct("license_matches.license"))
    return found.select(
        "doc_id", "n_words", F.size("license_matches").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licenses"),
        F.coalesce(F.array_max("license_matches.containment"), F.lit(0.0)).alias("containment"),
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similarity_classes(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_shingles")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages (page_id, url) and all documents (doc_id), each with its language."""
    pages, docs = read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents")
    model = language_id.fit_text(docs)
    answers = ["declared", "lang", "probability"]
    web = language_id.identified(pages, model, ["page_id", "url"])
    plain = language_id.identified_documents(docs, model, ["doc_id"])
    return web.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long"), "url", *answers).unionByName(
        plain.select("doc_id", F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), *answers)
    )


def held_out() -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id does not."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(3)) == 1, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~held_out()))
    rows = toxicity.scored(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.duplicate_spans(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extracted(read_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(read_table(spark, sf_dir, "documents"))
    return mix.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text_of()) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).cast("long").alias("text_crc32"),
    )
    placed = sharding.shard(docs, N_SHARDS, ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.linked_vectors(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clustering.clustered(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_mix_sources": op7_mix_sources,
    "op8_decontaminate": op8_decontaminate,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_feistel_shards": op10_feistel_shards,
    "op11_vector_links": op11_vector_links,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_phrase_collocations": op13_phrase_collocations,
}

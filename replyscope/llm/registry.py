"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyscope.llm.oracle import SQL  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from replyscope.llm.suffix_dedup import digest, remove_repeats

    # Beside the 400 bytes of the contract, the bytes in repeated strings of 250: about those of passages of over 50 words.
    return digest(remove_repeats(documents(spark, sf_dir), shorter=250)).withColumnRenamed("n_shorter", "n_passage_bytes")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from replyscope.llm.toxicity import score_documents

    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from replyscope.llm.licenses import license_scan

    return license_scan(documents(spark, sf_dir))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from replyscope.llm.mixing import mix_sources, taken

    return taken(*mix_sources(documents(spark, sf_dir)))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from replyscope.llm.ball_tree import top_k

    return top_k(embeddings(spark, sf_dir), F.col("vec_id") % 20 == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from replyscope.llm.line_dedup import digest, remove_lines

    return digest(remove_lines(documents(spark, sf_dir), min_bytes=1))


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from replyscope.llm.packing import digest, pack_documents

    return digest(pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op8_bfd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from replyscope.llm.bfd_packing import pack_rows

    return pack_rows(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from replyscope.llm.cross_polytope import near_vectors

    return near_vectors(embeddings(spark, sf_dir))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from replyscope.llm.simhash import simhash_components

    return simhash_components(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from replyscope.llm.filter_audit import filter_audit, masks

    return filter_audit(masks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from replyscope.llm.periodic_runs import digest, periodic_runs

    return digest(periodic_runs(documents(spark, sf_dir), planted=True))


def op13_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from replyscope.llm.common import new_folder
    from replyscope.llm.warc import read_archive, write_archive

    path = new_folder(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path).drop("url", "record_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_license_scan": op3_license_scan,
    "op4_mix_sources": op4_mix_sources,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_line_dedup": op6_line_dedup,
    "op7_harmonic_packing": op7_harmonic_packing,
    "op8_bfd_packing": op8_bfd_packing,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_warc_archive": op13_warc_archive,
}


"""Queries of the corpus operators, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import ball_tree, jaccard_join, line_dedup, preferences


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.ball_tree import quantised, top_k

    vectors = quantised(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandloom.llm.sentence_pieces import decode_pieces, encode_pieces

    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = decode_pieces(encode_pieces(_read(spark, sf_dir, "documents"), model), model)
    return rows.select("doc_id", F.size("token_ids").alias("n_tokens"), "token_ids", "score", (F.col("decoded") == F.col("text")).alias("round_trip"))


def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.sanitise import find_private

    found = find_private(_read(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["s"].cast("string"), s["e"].cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.jaccard_join import jaccard_join

    return jaccard_join(_read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.decontaminate import find_leaks

    found = find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    leaked = F.filter("_matches", lambda m: m["coverage"] >= 0.8)
    return found.select(
        "doc_id",
        "contaminated",
        F.transform(leaked, lambda m: m["item_id"]).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("_matches", lambda m: m["coverage"])), F.lit(0.0)).alias("max_coverage"),
        F.size("_matches").alias("n_seeded_items"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.line_dedup import dedup_lines

    return dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.toxicity import fit_toxicity, score_toxicity

    docs = _read(spark, sf_dir, "documents")
    model = fit_toxicity(docs, _read(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.preferences import conversations, format_preferences, swapped_pairs

    rows = format_preferences(swapped_pairs(conversations(_read(spark, sf_dir, "conversations"))))
    places = [F.array_join(F.transform(c, lambda m: F.concat_ws(":", m["s"].cast("string"), m["e"].cast("string"))), ",").alias(c) for c in ("chosen_mask", "rejected_mask")]
    return rows.select("pair_id", "n_common", "prompt", "chosen", "rejected", *places)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.log_bilinear import score_texts

    return score_texts(_read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandloom.llm.token_counts import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_top_k, op2_sentence_pieces, op3_private_data, op4_jaccard_join, op5_decontamination, op6_line_dedup, op7_toxicity, op8_preferences, op9_lm_scoring, op10_token_counts)}
SQL: dict[str, str] = {"op1_top_k": ball_tree.SQL, "op4_jaccard_join": jaccard_join.SQL, "op6_line_dedup": line_dedup.SQL, "op8_preferences": preferences.SQL}

"""Whole tasks in one call, with the defaults of a command line: align, msa, hmm_search, phylogeny, validate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import residues
from strandloom.functions.statistics import karlin_bits, karlin_evalue
from strandloom.operators import align as al
from strandloom.operators import hmm, profile, trees
from strandloom.operators.matrices import Matrix
from strandloom.sources import text


def align(queries: DataFrame, subjects: DataFrame, algorithm: str = "sw", matrix: Matrix | None = None, band: int | None = None) -> DataFrame:
    """Every query (id, sequence) against every subject (id, sequence): query_id, subject_id and the alignment's fields."""
    if algorithm not in ("sw", "nw"):
        raise ValueError(f"no algorithm {algorithm}")
    q = queries.select(F.col("id").alias("name"), "sequence")
    s = subjects.select(F.col("id").alias("ref_name"), F.col("sequence").alias("ref_sequence"))
    out = al.align_to_references(q, s, al.scheme(matrix, band=band), algorithm == "sw")
    return out.select(F.col("name").alias("query_id"), F.col("ref_name").alias("subject_id"), "alignment.*")


def as_sam(aligned: DataFrame) -> DataFrame:
    """Lines of SAM from align()."""
    return aligned.select(text.sam_line("query_id", "subject_id", "s_start", "cigar", "aligned_query", "score").alias("value"))


def msa(sequences: DataFrame, guide_tree: str = "upgma", threshold: float = 0.5) -> dict[str, DataFrame]:
    """Distances, guide tree, conservation and consensus of sequences (msa_id, seq_idx, sequence) that are aligned already."""
    return {
        "distances": profile.distance_matrix(sequences),
        "tree": trees.tree_texts(sequences, guide_tree),
        "conservation": profile.conservation(sequences),
        "consensus": profile.consensus(sequences, threshold),
    }


def hmm_search(sequences: DataFrame, model: hmm.Model, size: float = 1e6, evalue: float = 0.01) -> DataFrame:
    """sequences with viterbi, path, forward, bits, evalue and domains, those up to an E-value."""
    out = hmm.domains(hmm.search(sequences, model))
    bits = karlin_bits("forward")
    return out.withColumn("bits", bits).withColumn("evalue", karlin_evalue("bits", size)).where(F.col("evalue") <= evalue)


def phylogeny(sequences: DataFrame, method: str = "nj") -> DataFrame:
    """tree_id, newick and parsimony cost of each alignment."""
    return trees.tree_texts(sequences, method)


def validate(spark: SparkSession, path: str) -> DataFrame:
    """id and error (null: none) of each record of a sequence file."""
    return text.read_sequences(spark, path).select("id", residues.parse_error("sequence").alias("error"))

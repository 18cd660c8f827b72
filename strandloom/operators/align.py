"""Pairwise alignment as DataFrame operators: the work on a batch of pairs is one numpy program in an Arrow function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.dp import Scheme, align
from strandloom.operators.matrices import GapPenalty, Matrix, blosum62

FULL = "score int, q_start int, q_end int, s_start int, s_end int, cigar string, aligned_query string, aligned_subject string, clip_left int, clip_right int"
SCORE = "score int, q_end int, s_end int"


def scheme(matrix: Matrix | None = None, penalty: GapPenalty = GapPenalty(), edge: str = "extend", tie: str = "col", band: int | None = None, alphabet: str = "compat") -> Scheme:
    """Every gap cell costs penalty.extend; penalty.open counts on the border only, and there where edge is open or a band is set."""
    return Scheme((matrix or blosum62()).lookup(alphabet), penalty.extend, penalty.open, edge, tie, band)


def aligner(how: Scheme, local: bool = True, trace: bool = True):
    """Arrow function of (query, subject): a struct with the alignment; without trace only its score and end, for a fraction of the memory. Null where either is null or empty, or no alignment lies within the band."""

    @F.pandas_udf(FULL if trace else SCORE)
    def run(q: pd.Series, s: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(align([x or "" for x in q], [x or "" for x in s], how, local, trace))
        return out.astype({c: "Int32" for c in out.columns if c not in ("cigar", "aligned_query", "aligned_subject")})

    return run


def align_pairs(pairs: DataFrame, query: str = "query", subject: str = "subject", how: Scheme | None = None, local: bool = True, trace: bool = True, on_error: str = "null") -> DataFrame:
    """pairs with a struct column `alignment`. on_error=raise: a pair without one stops the job."""
    out = pairs.withColumn("alignment", aligner(how or scheme(), local, trace)(F.col(query), F.col(subject)))
    if on_error == "raise":
        bad = F.coalesce(F.length(query), F.lit(0)) * F.coalesce(F.length(subject), F.lit(0)) == 0
        out = out.withColumn("alignment", F.when(bad, F.raise_error("EmptySequence").cast(out.schema["alignment"].dataType)).otherwise(F.col("alignment")))
    return out


def align_to_references(queries: DataFrame, references: DataFrame, how: Scheme | None = None, local: bool = True, trace: bool = True, least_score: int | None = None, most_broadcast: int = 8 << 20) -> DataFrame:
    """Every query (name, sequence) against every reference (ref_name, ref_sequence).

    The references are broadcast if their total length, which is counted first, is within `most_broadcast`; beyond that
    they are worked through as a plain nested-loop join of partitions. With least_score, pairs whose shorter sequence is
    too short to reach it, by the matrix's largest score, are left out before the alignment: gaps cost, so no pair is lost.
    """
    how = how or scheme()
    size = references.agg(F.sum(F.length("ref_sequence"))).first()[0] or 0
    right = F.broadcast(references) if size <= most_broadcast else references
    pairs = queries.crossJoin(right)
    if least_score is not None:
        most = int(how.scores.max())
        pairs = pairs.where(F.least(F.length("sequence"), F.length("ref_sequence")) * most >= least_score)
    out = align_pairs(pairs, "sequence", "ref_sequence", how, local, trace)
    return out.where(F.col("alignment.score") >= least_score) if least_score is not None else out


def best_hits(aligned: DataFrame, key: str, k: int = 1, tie: str = "ref_name") -> DataFrame:
    """The k highest scores of each key, ties to the smaller `tie`."""
    order = Window.partitionBy(key).orderBy(F.desc("alignment.score"), tie)
    return aligned.withColumn("hit", F.row_number().over(order)).where(F.col("hit") <= k)


def filter_by_score(aligned: DataFrame, least: int) -> DataFrame:
    return aligned.where(F.col("alignment.score") >= least)


def filter_by_identity(aligned: DataFrame, least: float) -> DataFrame:
    from strandloom.functions.cigar import identity

    return aligned.where(identity("alignment.aligned_query", "alignment.aligned_subject") >= least)


def strategy(m: Column | str, n: Column | str, gpu: bool = False, similarity: Column | None = None) -> Column:
    """The kernel that a pair of these lengths suits: under 2**20 cells vectors, else a band; with a device also its kernels."""
    m, n = (F.col(x) if isinstance(x, str) else x for x in (m, n))
    cells = m.cast("long") * n.cast("long")
    if not gpu:
        return F.when(cells < 1 << 20, "Simd").otherwise("Banded")
    alike = F.coalesce(similarity > 0.7, F.lit(False)) if similarity is not None else F.lit(False)
    return F.when(cells <= 1024, "Scalar").when(cells > 1 << 20, "GpuTiled").when(alike, "Banded").otherwise("GpuFull")

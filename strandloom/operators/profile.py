"""Column statistics of alignments, profiles and position weights: counts by (alignment, column, residue), then arithmetic.

An alignment is a table (msa_id, seq_idx, sequence). Every statistic starts from counts that are combined before the
shuffle, so its cost after it is columns times residues, however many sequences an alignment has.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.residues import ALPHABET, ALPHABETICAL
from strandloom.operators.matrices import FREQUENCIES
from strandloom.operators.pairwise import against_all, pairwise

GAPS = ("-", ".")


#: Rows of a table of columns and residues that is broadcast at most.
MOST_BROADCAST = 500_000


def columns(msa: DataFrame) -> DataFrame:
    """(msa_id, seq_idx, pos, aa) and what else msa holds, pos from 0."""
    more = [c for c in msa.columns if c not in ("msa_id", "seq_idx", "sequence")]
    return msa.select("msa_id", "seq_idx", *more, F.posexplode(F.split("sequence", "")).alias("pos", "aa")).where(F.col("aa") != "")


def near(table: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A table with a row for each column and residue, to be broadcast if it has `most` rows or fewer, which is counted; its other side then stays where it is."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def sizes(msa: DataFrame) -> DataFrame:
    """(msa_id, n, width): sequences, and the length of the first one, whose columns count."""
    return msa.groupBy("msa_id").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.length("sequence"), "seq_idx").alias("width"))


def counts(msa: DataFrame) -> DataFrame:
    """(msa_id, pos, aa, c)."""
    return columns(msa).groupBy("msa_id", "pos", "aa").agg(F.count(F.lit(1)).alias("c"))


def consensus(msa: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(msa_id, consensus): each column's most frequent residue if its share of all sequences reaches the threshold, else X; ties to the smaller code."""
    best = counts(msa).groupBy("msa_id", "pos").agg(F.min(F.struct((-F.col("c")).alias("c"), "aa")).alias("b"))
    shown = best.join(sizes(msa), "msa_id").where(F.col("pos") < F.col("width"))
    letter = F.when(-F.col("b.c") / F.col("n") >= threshold, F.col("b.aa")).otherwise("X")
    return shown.groupBy("msa_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", letter.alias("l")))), lambda x: x["l"]), "").alias("consensus"))


def conservation(msa: DataFrame) -> DataFrame:
    """(msa_id, pos, conservation): 1 less the column's entropy over that of twenty equal residues, held within 0 and 1."""
    each = counts(msa)
    total = each.groupBy("msa_id", "pos").agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.log2("c")).alias("cl"))
    entropy = F.log2("t") - F.col("cl") / F.col("t")
    return total.select("msa_id", "pos", (1 - F.least(F.greatest(entropy / math.log2(20), F.lit(0.0)), F.lit(1.0))).alias("conservation"))


def frequencies(msa: DataFrame) -> DataFrame:
    """(msa_id, pos, aa, freq): share of all sequences, gaps too."""
    return counts(msa).join(sizes(msa).select("msa_id", "n"), "msa_id").select("msa_id", "pos", "aa", (F.col("c") / F.col("n")).alias("freq"))


def henikoff_weights(msa: DataFrame) -> DataFrame:
    """(msa_id, seq_idx, weight): sum over columns of 1 / (kinds of residue there x copies of the own one), gaps apart, scaled to a sum of n.

    Residues of a sequence stand together, so their sums are combined before the shuffle, which then has a row for each.
    """
    each = columns(msa).where(~F.col("aa").isin(*GAPS))
    known = counts(msa).where(~F.col("aa").isin(*GAPS))
    kinds = known.groupBy("msa_id", "pos").agg(F.count(F.lit(1)).alias("kinds"))
    share = known.join(kinds, ["msa_id", "pos"]).select("msa_id", "pos", "aa", (1.0 / (F.col("kinds") * F.col("c"))).alias("w"))
    raw = each.join(near(share), ["msa_id", "pos", "aa"]).groupBy("msa_id", "seq_idx").agg(F.sum("w").alias("w"))
    total = near(sizes(msa).select("msa_id", "n").join(raw.groupBy("msa_id").agg(F.sum("w").alias("t")), "msa_id", "left"))
    every = msa.select("msa_id", "seq_idx").join(raw, ["msa_id", "seq_idx"], "left").join(total, "msa_id")
    return every.select("msa_id", "seq_idx", F.coalesce(F.col("w") * F.col("n") / F.col("t"), F.lit(1.0)).alias("weight"))


def weighted_counts(msa: DataFrame, weights: DataFrame) -> DataFrame:
    """(msa_id, pos, aa, f) over the twenty residues, absent ones at 0."""
    each = columns(msa.join(weights, ["msa_id", "seq_idx"])).where(F.instr(F.lit(ALPHABETICAL), F.col("aa")) > 0)
    found = each.groupBy("msa_id", "pos", "aa").agg(F.sum("weight").alias("f"))
    places = sizes(msa).select("msa_id", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("pos"))
    grid = places.withColumn("aa", F.explode(F.split(F.lit(ALPHABETICAL), ""))).where(F.col("aa") != "")
    return grid.join(found, ["msa_id", "pos", "aa"], "left").withColumn("f", F.coalesce("f", F.lit(0.0)))


def log_odds(table: DataFrame, pseudo: float = 1.0, background: float = 0.05) -> DataFrame:
    """table with pssm: log2 of the smoothed share (f / total + s b) / (1 + s) over the background b; 0 in a column without residues."""
    total = F.sum("f").over(Window.partitionBy("msa_id", "pos"))
    share = (F.when(total > 0, F.try_divide("f", total)).otherwise(background) + pseudo * background) / (1 + pseudo)
    return table.withColumn("pssm", F.log2(share / background))


def pipeline_pssm(msa: DataFrame, pseudo: float = 1.0) -> DataFrame:
    """Weights, weighted frequencies and log odds of an alignment."""
    return log_odds(weighted_counts(msa, henikoff_weights(msa)), pseudo)


def background(aa: Column | str) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in FREQUENCIES.items() for x in (k, v)))
    return table[F.col(aa) if isinstance(aa, str) else aa]


def natural_pssm(msa: DataFrame) -> DataFrame:
    """(msa_id, pos, aa, score): ln of ((count + 0.5) / n over the background), for residues of the background that a column holds."""
    return counts(msa).join(sizes(msa).select("msa_id", "n"), "msa_id").where(background("aa").isNotNull()).select("msa_id", "pos", "aa", F.log((F.col("c") + 0.5) / F.col("n") / background("aa")).alias("score"))


def gap_penalties(msa: DataFrame) -> DataFrame:
    """(msa_id, pos, gap_open, gap_extend): opening costs 11 where nothing is conserved, and less by the square of the conservation."""
    c = F.col("conservation")
    return conservation(msa).select("msa_id", "pos", (-11.0 * (1 - c * c) + 0.0).alias("gap_open"), F.lit(-1.0).alias("gap_extend"))


def wide_pssm(msa: DataFrame, weights: DataFrame, letters: int = 24) -> DataFrame:
    """(msa_id, pos, aa, p, pssm): p = (w + 1) / (W + letters), pssm = ln max(p letters, 0.001), for residues that a column holds."""
    each = columns(msa.join(weights, ["msa_id", "seq_idx"])).groupBy("msa_id", "pos", "aa").agg(F.sum("weight").alias("w"))
    total = each.groupBy("msa_id", "pos").agg(F.sum("w").alias("t"))
    p = (F.col("w") + 1) / (F.col("t") + letters)
    return each.join(total, ["msa_id", "pos"]).select("msa_id", "pos", "aa", p.alias("p"), F.log(F.greatest(p * letters, F.lit(0.001))).alias("pssm"))


def dirichlet(score: Column | str, alpha: float, letters: int = 24) -> Column:
    return (F.col(score) if isinstance(score, str) else score) * (1 - alpha) + math.log(1 / letters) * alpha


def divergence(table: DataFrame, letters: int = 24) -> DataFrame:
    """(msa_id, pos, entropy, kl) in nats of a table of p, against equal background."""
    p = F.col("p")
    return table.where("p > 0").groupBy("msa_id", "pos").agg(F.sum(-p * F.log(p)).alias("entropy"), F.sum(p * F.log(p * letters)).alias("kl"))


def score_profile(seqs: DataFrame, pssm: DataFrame, score: str = "pssm") -> DataFrame:
    """(msa_id, seq_idx, score): each sequence's sum of its residues' scores in its columns; what the profile lacks counts nothing."""
    return columns(seqs).join(near(pssm.select("msa_id", "pos", "aa", F.col(score).alias("_s"))), ["msa_id", "pos", "aa"], "left").groupBy("msa_id", "seq_idx").agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("score"))


def score_frequency(pssm: DataFrame, least: float, score: str = "pssm") -> DataFrame:
    """(msa_id, pos, n): residues of each column that score `least` or more."""
    return pssm.groupBy("msa_id", "pos").agg(F.sum((F.col(score) >= least).cast("int")).alias("n"))


def profile_consensus(pssm: DataFrame, score: str = "pssm") -> DataFrame:
    """(msa_id, consensus): the best-scoring residue of each column, of equal ones the first by letter."""
    best = pssm.groupBy("msa_id", "pos").agg(F.min(F.struct((-F.col(score)).alias("s"), "aa"))["aa"].alias("l"))
    return best.groupBy("msa_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "l"))), lambda x: x["l"]), "").alias("consensus"))


def column_score(seqs: DataFrame, pssm: DataFrame, missing: float = 0.0, score: str = "pssm") -> DataFrame:
    """(msa_id, seq_idx, pos, aa, score): each residue's score in its column, `missing` where the profile lacks it."""
    return columns(seqs).join(near(pssm.select("msa_id", "pos", "aa", F.col(score).alias("score"))), ["msa_id", "pos", "aa"], "left").fillna({"score": missing})


def gapped_columns(msa: DataFrame, share: float = 0.5) -> DataFrame:
    """(msa_id, pos, gapped): whether more than `share` of the column is gap."""
    return columns(msa).groupBy("msa_id", "pos").agg((F.avg(F.col("aa").isin(*GAPS).cast("int")) > share).alias("gapped"))


def _vectors(profile: DataFrame, value: str, side: str) -> DataFrame:
    """(side_id, side_pos, side_v): each column as an array of its residues' values in a fixed order, 0 for what it lacks."""
    letters = F.filter(F.split(F.lit(ALPHABET), ""), lambda c: c != "")
    column = profile.groupBy("msa_id", "pos").agg(F.map_from_entries(F.collect_list(F.struct("aa", F.col(value).cast("double")))).alias("m"))
    return column.select(F.col("msa_id").alias(f"{side}_id"), F.col("pos").alias(f"{side}_pos"), F.transform(letters, lambda c: F.coalesce(F.col("m")[c], F.lit(0.0))).alias(f"{side}_v"))


def _product() -> Column:
    return F.aggregate(F.zip_with("a_v", "b_v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("similarity")


def profile_similarity(a: DataFrame, b: DataFrame, value: str = "pssm") -> DataFrame:
    """(a_pos, b_pos, similarity): sums of products over residues, of all columns of two profiles (one alignment's each)."""
    return _vectors(a, value, "a").crossJoin(near(_vectors(b, value, "b"))).select("a_pos", "b_pos", _product())


def profile_similarities(profiles: DataFrame, value: str = "pssm") -> DataFrame:
    """(a_id, b_id, a_pos, b_pos, similarity), a_id < b_id: profile_similarity of every pair of alignments' profiles (msa_id, pos, aa)."""
    left, right = _vectors(profiles, value, "a"), near(_vectors(profiles, value, "b"))
    return left.join(right, F.col("a_id") < F.col("b_id")).select("a_id", "b_id", "a_pos", "b_pos", _product())


def hamming(a: Column | str, b: Column | str) -> Column:
    """Share of differing places over the longer length; what is missing counts as a gap."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    n = F.greatest(F.length(a), F.length(b))
    pad = lambda s: F.split(F.rpad(s, n, F.lit("-")), "")
    differ = F.size(F.filter(F.zip_with(pad(a), pad(b), lambda x, y: x != y), lambda t: F.coalesce(t, F.lit(False))))
    return F.when(n > 0, differ / n).otherwise(0.0)


def distance_matrix(msa: DataFrame) -> DataFrame:
    """(msa_id, i, j, distance), i < j: share of differing places over the longer length, of all pairs within an alignment, which is what a distance matrix is."""
    return pairwise(msa).select("msa_id", "i", "j", (F.col("differ") / F.greatest(F.col("width"), F.lit(1))).alias("distance"))


def distance_searches(msa: DataFrame, queries: Column) -> DataFrame:
    """(msa_id, i, j, distance) of each row i for which `queries` holds with every other row j of its alignment."""
    return against_all(msa, queries, "differ", lambda differ, width: differ / np.maximum(width, 1))


def coverage(seqs: DataFrame) -> DataFrame:
    """(msa_id, pos, coverage): share of sequences that reach each place of the first one."""
    s = sizes(seqs)
    reach = columns(seqs).groupBy("msa_id", "pos").agg(F.count(F.lit(1)).alias("c"))
    return reach.join(s, "msa_id").where(F.col("pos") < F.col("width")).select("msa_id", "pos", (F.col("c") / F.col("n")).alias("coverage"))

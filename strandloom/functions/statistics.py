"""Significance of scores: four families that don't agree, each under its name."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters of the score distributions.
KARLIN = {"lambda": 0.3176, "k": 0.134, "h": 0.4012, "log_k": -2.004}
PFAM_PROTEIN = {"lambda": 0.318, "k": 0.135, "mu": 35.0}
PFAM_NUCLEOTIDE = {"lambda": 1.37, "k": 0.711, "mu": 38.7}
PROFILE_DATABASE = 6e9


def _col(c: Column | str | float) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c))


def karlin_bits(score: Column | str, p: dict = KARLIN) -> Column:
    return (p["lambda"] * _col(score) - p["log_k"]) / math.log(2)


def karlin_evalue(bits: Column | str, size: Column | str | float, p: dict = KARLIN) -> Column:
    """K N exp(-lambda S), where S is the score that the bits stand for."""
    back = (_col(bits) * math.log(2) + p["log_k"]) / p["lambda"]
    return p["k"] * _col(size) * F.exp(-p["lambda"] * back)


def profile_evalue(bits: Column | str) -> Column:
    return karlin_evalue(bits, PROFILE_DATABASE)


def pfam_evalue(bits: Column | str, size: Column | str | float, p: dict = PFAM_PROTEIN) -> Column:
    return p["k"] * _col(size) * F.exp(-_col(bits))


def pfam_bits(score: Column | str, p: dict = PFAM_PROTEIN) -> Column:
    return (p["lambda"] * _col(score) - math.log(p["mu"])) / math.log(2)


def pfam_pvalue(score: Column | str, p: dict = PFAM_PROTEIN) -> Column:
    return F.exp(-p["lambda"] * _col(score))


def passes(score: Column | str, cutoff: Column | str) -> Column:
    """Score at the cutoff or above; a missing cutoff passes all."""
    return F.coalesce(_col(score) >= _col(cutoff), F.lit(True))

"""Substitution matrices: one built in, others read as parameters; gap penalties."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.residues import ALPHABET

OUT_OF_RANGE = -100

# BLOSUM62 as published, in half bits; the matrix is symmetric, so each row ends at its own column.
PUBLISHED_ORDER = "ARNDCQEGHILKMFPSTWYVBZX*"
BLOSUM62 = """
A  4
R -1  5
N -2  0  6
D -2 -2  1  6
C  0 -3 -3 -3  9
Q -1  1  0  0 -3  5
E -1  0  0  2 -4  2  5
G  0 -2  0 -1 -3 -2 -2  6
H -2  0  1 -1 -3  0  0 -2  8
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
W -3 -3 -4 -4 -2 -2 -3 -4 -2 -3 -2 -3 -1  1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
B -2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4
Z -1  0  0  1 -3  4  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  5
X -1 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1 -1 -1
* -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4  1
"""
# Background frequencies of the residues.
FREQUENCIES = {"A": 0.078, "R": 0.051, "N": 0.045, "D": 0.054, "C": 0.019, "Q": 0.043, "E": 0.063, "G": 0.074, "H": 0.022, "I": 0.051, "L": 0.091, "K": 0.057, "M": 0.022, "F": 0.039, "P": 0.052, "S": 0.071, "T": 0.058, "W": 0.013, "Y": 0.032, "V": 0.064}


@dataclass(frozen=True)
class GapPenalty:
    """Costs of opening and extending a gap, both 0 or less."""

    open: int = -11
    extend: int = -1

    def __post_init__(self) -> None:
        if self.open > 0 or self.extend > 0:
            raise ValueError("gap penalties must be 0 or less")

    @classmethod
    def strict(cls) -> "GapPenalty":
        return cls(-16, -4)

    @classmethod
    def liberal(cls) -> "GapPenalty":
        return cls(-8, -1)


@dataclass(frozen=True)
class Matrix:
    """24 x 24 scores in the published order of residues."""

    name: str
    rows: np.ndarray = field(repr=False)

    def __post_init__(self) -> None:
        if self.rows.shape != (24, 24):
            raise ValueError(f"{self.name}: a matrix has 24 rows and columns")

    def score(self, a: int, b: int) -> int:
        return int(self.rows[a, b]) if 0 <= a < 24 and 0 <= b < 24 else OUT_OF_RANGE

    def lookup(self, alphabet: str = "compat") -> np.ndarray:
        """Scores by the place in ALPHABET. compat: the place is taken as the row; ncbi: the residue's own row (the gap's is the stop's)."""
        if alphabet == "compat":
            return self.rows
        at = [PUBLISHED_ORDER.index("*" if c == "-" else c) for c in ALPHABET]
        return self.rows[np.ix_(at, at)]

    def frame(self, spark: SparkSession, alphabet: str = "compat") -> DataFrame:
        """(matrix, aa1, aa2, score), 576 rows."""
        m = self.lookup(alphabet)
        return spark.createDataFrame([(self.name, a, b, int(m[i, j])) for i, a in enumerate(ALPHABET) for j, b in enumerate(ALPHABET)], "matrix string, aa1 string, aa2 string, score int")


def blosum62() -> Matrix:
    """The published half, mirrored."""
    half = np.zeros((24, 24), dtype=np.int32)
    for i, line in enumerate(BLOSUM62.split("\n")[1:-1]):
        half[i, : i + 1] = [int(x) for x in line.split()[1:]]
    return Matrix("BLOSUM62", half + half.T - np.diag(np.diag(half)))


def log_odds(name: str, target: np.ndarray, background: np.ndarray, scale: float = 2.0) -> Matrix:
    """A matrix of a family from its target frequencies (20 x 20 in the published order, symmetric, summing to 1) and background: scale * log2 of their odds, rounded.

    B, Z and X score as the pairs that they stand for do together; a stop scores 1 with itself and the least of all scores
    with any residue.
    """
    stands = {c: [i] for i, c in enumerate(PUBLISHED_ORDER[:20])} | {"B": [2, 3], "Z": [5, 6], "X": list(range(20))}
    codes = PUBLISHED_ORDER[:23]
    odds = np.array([[target[np.ix_(stands[a], stands[b])].sum() / (background[stands[a]].sum() * background[stands[b]].sum()) for b in codes] for a in codes])
    rows = np.ones((24, 24), dtype=np.int32)
    rows[:23, :23] = np.rint(scale * np.log2(np.maximum(odds, 1e-9)))
    rows[23, :23] = rows[:23, 23] = rows[:20, :20].min()
    return Matrix(name, rows)


def point_accepted(name: str, step: np.ndarray, background: np.ndarray, distance: int, scale: float = 2.0) -> Matrix:
    """The matrix of a mutation family at a distance: the chance `step` (20 x 20, rows sum to 1) of each change over one unit, raised to `distance`, as log odds."""
    joint = background[:, None] * np.linalg.matrix_power(step, distance)
    return log_odds(name, (joint + joint.T) / 2, background, scale)


def simple(match: int = 2, mismatch: int = -1) -> Matrix:
    """One score for equal residues and one for all others; with a gap of -2 the usual scheme of nucleotides."""
    return Matrix(f"simple({match},{mismatch})", np.where(np.eye(24, dtype=bool), match, mismatch).astype(np.int32))


def parse_matrix(name: str, text: str) -> Matrix:
    """A matrix in the usual text format: a header of codes, then a row for each; comments start with #. So any other matrix is a parameter."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    if not lines:
        raise ValueError(f"{name}: no rows")
    head, got = lines[0], {}
    for row in lines[1:]:
        if len(row) != len(head) + 1:
            raise ValueError(f"{name}: row {row[0]} has {len(row) - 1} scores, not {len(head)}")
        got[row[0]] = dict(zip(head, map(int, row[1:])))
    missing = [c for c in PUBLISHED_ORDER if c not in got or c not in head]
    if missing:
        raise ValueError(f"{name}: no scores of {' '.join(missing)}")
    return Matrix(name, np.array([[got[a][b] for b in PUBLISHED_ORDER] for a in PUBLISHED_ORDER], dtype=np.int32))


def read_matrices(spark: SparkSession, path: str) -> dict[str, Matrix]:
    """Matrices in the files of a path that Spark reads, by file name without its suffix. A matrix is some kB."""
    rows = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name")).collect()
    return {r["name"]: parse_matrix(r["name"], r["value"]) for r in rows}


def validate(matrix: DataFrame) -> DataFrame:
    """matrix, cells, symmetric, scaled (all within -50 and 50), low, high for each matrix of a long table."""
    m = matrix.alias("m")
    other = matrix.select("matrix", F.col("aa1").alias("aa2"), F.col("aa2").alias("aa1"), F.col("score").alias("mirror"))
    return (
        m.join(other, ["matrix", "aa1", "aa2"])
        .groupBy("matrix")
        .agg(F.count(F.lit(1)).alias("cells"), F.bool_and(F.col("score") == F.col("mirror")).alias("symmetric"), F.min("score").alias("low"), F.max("score").alias("high"))
        .withColumn("scaled", (F.col("low") >= -50) & (F.col("high") <= 50))
    )

"""Alignment against profiles: a sequence or a profile against columns of scores, with affine gaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.residues import ALPHABET


def gotoh(scores: np.ndarray, gap_open: float = -11.0, gap_extend: float = -1.0, local: bool = False) -> tuple[float, str, int, int]:
    """Best path through a matrix of column scores (rows x columns): (score, letters M, I, D, first row, first column).

    A gap of k costs gap_open + (k - 1) gap_extend; I takes a row, D a column. Of equal scores M comes before I, and I before D.
    """
    m, n = scores.shape
    low = -np.inf
    best = np.full((3, m + 1, n + 1), low)
    back = np.full((3, m + 1, n + 1), -1, dtype=np.int8)
    best[0, 0, 0] = 0.0
    for i in range(m + 1):
        for j in range(n + 1):
            if i and j:
                before = best[:, i - 1, j - 1]
                k = int(before.argmax())
                start = max(before[k], 0.0) if local else before[k]
                best[0, i, j], back[0, i, j] = start + scores[i - 1, j - 1], k if start == before[k] and before[k] > low else -1
            for state, (a, b) in ((1, (i - 1, j)), (2, (i, j - 1))):
                if a >= 0 and b >= 0:
                    ways = best[:, a, b] + np.where(np.arange(3) == state, gap_extend, gap_open)
                    k = int(ways.argmax())
                    best[state, i, j], back[state, i, j] = ways[k], k
    if local:
        state, i, j = (int(x) for x in np.unravel_index(np.where(np.arange(3)[:, None, None] == 0, best, low).argmax(), best.shape))
        if best[state, i, j] <= 0:
            return 0.0, "", 0, 0
    else:
        state, i, j = int(best[:, m, n].argmax()), m, n
    score, letters = float(best[state, i, j]), []
    while state >= 0 and (i or j):
        letters.append("MID"[state])
        k = int(back[state, i, j])
        i, j = i - (state < 2), j - (state != 1)
        state = k
    return score, "".join(reversed(letters)), i, j


def profile_matrix(table: DataFrame, width: int, score: str = "pssm") -> np.ndarray:
    """width x 24 scores of one profile's long table; what it lacks scores its column's least."""
    out = np.full((width, 24), np.nan)
    for r in table.select("pos", "aa", score).collect():
        at = ALPHABET.find(r["aa"])
        if at >= 0 and r["pos"] < width:
            out[r["pos"], at] = r[score]
    least = np.where(np.isnan(out).all(1), 0.0, np.nanmin(np.where(np.isnan(out), np.inf, out), axis=1))
    return np.where(np.isnan(out), least[:, None], out)


def align_to_profile(seqs: DataFrame, columns: np.ndarray, sequence: str = "sequence", gap_open: float = -11.0, gap_extend: float = -1.0, local: bool = False) -> DataFrame:
    """seqs with path (M, I, D), path_score, and gapped: the sequence with - where the profile goes on alone. The profile is broadcast."""
    sent = seqs.sparkSession.sparkContext.broadcast(columns)

    @F.pandas_udf("path string, path_score double, gapped string")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for x in s:
            known = [c for c in (x or "").upper() if c in ALPHABET]
            scores = sent.value[:, [ALPHABET.index(c) for c in known]].T.reshape(len(known), len(sent.value))
            score, path, at, _ = gotoh(scores, gap_open, gap_extend, local)
            text = []
            for c in path:
                text.append("-" if c == "D" else known[at])
                at += c != "D"
            out.append((path, score, "".join(text)))
        return pd.DataFrame(out, columns=["path", "path_score", "gapped"])

    return seqs.withColumn("_p", run(sequence)).select("*", "_p.path", "_p.path_score", "_p.gapped").drop("_p")


def align_profiles(a: np.ndarray, b: np.ndarray, gap_open: float = -11.0, gap_extend: float = -1.0) -> tuple[float, str]:
    """Score and path of two profiles: columns score the sum of products of their residues' frequencies or scores."""
    score, path, _, _ = gotoh(a @ b.T, gap_open, gap_extend)
    return score, path

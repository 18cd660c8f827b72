"""Interchange records: sequences as codes with metadata."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import cigar
from strandloom.functions.statistics import karlin_bits, karlin_evalue
from strandloom.operators.matrices import GapPenalty, Matrix, blosum62

from strandloom.functions.residues import BRIDGE_ALPHABET, bridge_index, nucleotide_index, three_letter


def _codes(sequence: str, index) -> F.Column:
    return F.transform(F.filter(F.split(sequence, ""), lambda c: c != ""), index)


def protein_record(rows: DataFrame, id_col: str, sequence: str, database: str = "Ensembl", taxon: int = 9606) -> DataFrame:
    """(id, codes, type, metadata); codes are null for a gap, which the encoding lacks."""
    meta = F.create_map(F.lit("database"), F.lit(database), F.lit("taxon"), F.lit(str(taxon)))
    return rows.select(F.col(id_col).cast("string").alias("id"), _codes(sequence, bridge_index).alias("codes"), F.lit("Protein").alias("type"), meta.alias("metadata"))


def dna_record(rows: DataFrame, id_col: str, sequence: str) -> DataFrame:
    """(id, codes, type): ACGT as 0-3, all else 4."""
    return rows.select(F.col(id_col).cast("string").alias("id"), _codes(sequence, nucleotide_index).alias("codes"), F.lit("DNA").alias("type"))


def protein_sequence(records: DataFrame) -> DataFrame:
    """(id, sequence, error) back from protein records."""
    letters = F.array_join(F.transform("codes", lambda c: F.substring(F.lit(BRIDGE_ALPHABET), c + 1, F.lit(1))), "")
    error = F.when(F.col("type") != "Protein", "type").when(F.size("codes") == 0, "EmptySequence")
    return records.select("id", F.when(error.isNull(), letters).alias("sequence"), error.alias("error"))


def long_names(records: DataFrame) -> DataFrame:
    return records.withColumn("names", F.transform("codes", three_letter))


def dna_sequence(records: DataFrame) -> DataFrame:
    """(id, sequence) back from records: DNA codes as letters, all but 0-3 as N; records of another type are empty."""
    letter = lambda c: F.when(c.between(0, 3), F.substring(F.lit("ACGT"), c + 1, F.lit(1))).otherwise("N")
    return records.select("id", F.when(F.col("type") == "DNA", F.array_join(F.transform("codes", letter), "")).otherwise("").alias("sequence"))


def alignment_record(aligned: DataFrame, query_id: str, subject_id: str, size: Column | float = 1e6) -> DataFrame:
    """Records of alignments (columns score, cigar, aligned_query, aligned_subject): ends by the CIGAR's lengths from 1 on, bits of 0 at least, E-value for a database of `size`, residues and gaps of the query's row, and the share of residues in the CIGAR's query length."""
    ops = cigar.parse("cigar")
    length = cigar.query_length(ops)
    gaps = F.length("aligned_query") - F.length(F.replace("aligned_query", F.lit("-"), F.lit("")))
    residues = F.length("aligned_query") - gaps
    bits = karlin_bits("score")
    return aligned.select(
        F.col(query_id).cast("string").alias("query_id"), F.col(subject_id).cast("string").alias("subject_id"), "score",
        karlin_evalue(bits, size).alias("evalue"), F.greatest(bits, F.lit(0.0)).alias("bit_score"),
        F.when(length > 0, residues / length).otherwise(0.0).alias("identity"),
        F.lit(1).alias("query_start"), (length + 1).alias("query_end"), F.lit(1).alias("subject_start"), (cigar.reference_length(ops) + 1).alias("subject_end"),
        residues.alias("matches"), length.alias("alignment_length"), F.lit(1).alias("gap_opens"), gaps.alias("gaps"), "cigar",
        F.col("aligned_query").alias("query_string"), F.col("aligned_subject").alias("subject_string"),
    )


def matrix_record(spark: SparkSession, matrix: Matrix, penalty: GapPenalty = GapPenalty()) -> DataFrame:
    """(name, scores, size, gap_open, gap_extend, reference), one row."""
    row = (matrix.name, matrix.rows.tolist(), len(matrix.rows), penalty.open, penalty.extend, "NCBI Standard")
    return spark.createDataFrame([row], "name string, scores array<array<int>>, size int, gap_open int, gap_extend int, reference string")


def record_matrix(records: DataFrame, known: dict[str, Matrix] | None = None) -> dict[str, Matrix]:
    """A matrix for each record by its name: a known one, in whatever case; else its own scores if they are 24 x 24; else the default."""
    known = {k.upper(): v for k, v in ((known or {}) | {"BLOSUM62": blosum62()}).items()}
    out = {}
    for r in records.select("name", "scores").collect():
        own = np.array(r["scores"] or [], dtype=np.int32)
        out[r["name"]] = known.get(r["name"].upper()) or (Matrix(r["name"], own) if own.shape == (24, 24) else known["BLOSUM62"])
    return out


def flagged(records: DataFrame, flag: Column) -> DataFrame:
    """records with clinical_flags, an array, longer by `flag` where that isn't null, and clinically_significant: whether there is any."""
    none = F.array().cast("array<string>")
    before = F.coalesce("clinical_flags", none) if "clinical_flags" in records.columns else none
    out = records.withColumn("clinical_flags", F.concat(before, F.when(flag.isNotNull(), F.array(flag)).otherwise(none)))
    return out.withColumn("clinically_significant", F.size("clinical_flags") > 0)

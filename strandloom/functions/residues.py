"""Residue alphabets as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Orders of residue codes that indices refer to.
ALPHABET = "ARNDCEQGHILKMFPSTWYVBX*-"
BRIDGE_ALPHABET = "ARNDCEQGHILKMFPSTWYVBZX*"
ALPHABETICAL = "ACDEFGHIKLMNPQRSTVWY"
NUCLEOTIDES = "ACGT"
THREE_LETTER = "Ala Arg Asn Asp Cys Glu Gln Gly His Ile Leu Lys Met Phe Pro Ser Thr Trp Tyr Val Asx Glx Xaa ***".split()


def index_in(alphabet: str, code: Column | str, missing: int | None = None) -> Column:
    """Place of a one-letter code, from 0; `missing` (null by default) for codes outside the alphabet."""
    code = F.col(code) if isinstance(code, str) else code
    at = F.instr(F.lit(alphabet), F.upper(code))
    return F.when((F.length(code) == 1) & (at > 0), at - 1).otherwise(F.lit(missing).cast("int"))


def aa_index(code: Column | str) -> Column:
    return index_in(ALPHABET, code)


def bridge_index(code: Column | str) -> Column:
    return index_in(BRIDGE_ALPHABET, code)


def parsimony_index(code: Column | str) -> Column:
    return index_in(ALPHABETICAL, code, len(ALPHABETICAL))


def nucleotide_index(code: Column | str) -> Column:
    return index_in(NUCLEOTIDES, code, len(NUCLEOTIDES))


def aa_code(index: Column | str) -> Column:
    index = F.col(index) if isinstance(index, str) else index
    return F.when(index.between(0, len(ALPHABET) - 1), F.substring(F.lit(ALPHABET), index + 1, F.lit(1)))


def three_letter(index: Column | str) -> Column:
    index = F.col(index) if isinstance(index, str) else index
    return F.get(F.array(*(F.lit(x) for x in THREE_LETTER)), index)


def parse_sequence(text: Column | str) -> Column:
    """White space gone, upper case; null where nothing is left or a code is unknown."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.upper(F.regexp_replace(text, r"\s", ""))
    return F.when(found.rlike(r"^[ARNDCEQGHILKMFPSTWYVBX*\-]+$"), found)


def parse_error(text: Column | str) -> Column:
    """Why parse_sequence gives null: EmptySequence or InvalidAminoAcid."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")
    return F.when(bare == "", "EmptySequence").when(parse_sequence(text).isNull(), "InvalidAminoAcid")


def derived_sequence(text: Column | str) -> Column:
    """The residues that the Latin letters of a text spell."""
    text = F.col(text) if isinstance(text, str) else text
    letters = F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.regexp_replace(letters, "[JOUZ]", "")

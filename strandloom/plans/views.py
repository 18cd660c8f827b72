"""Views that the registered queries share, in Spark and in SQL. All cover whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.residues import ALPHABET, derived_sequence
from strandloom.operators.matrices import blosum62

#: The region whose name is the reference that whole documents are aligned to.
REFERENCE_KEY = 4


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, seq): the residues that each whole document spells, where it spells any."""
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", derived_sequence("text").alias("seq")).where("seq <> ''")


def _gapped(sequence: Column, doc_id: Column) -> Column:
    """Every fifth document has gaps in place of its A."""
    return F.when(doc_id % 5 == 0, F.replace(sequence, F.lit("A"), F.lit("-"))).otherwise(sequence)


def msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msa_id, seq_idx, sequence): every word of every document; the words of one language that spell as many residues are one alignment."""
    words = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.regexp_replace(F.upper(w), "[JOUZ]", ""))
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(words).alias("place", "w")).where("w <> ''")
    return rows.select(F.concat_ws("-", "lang", F.length("w").cast("string")).alias("msa_id"), (F.col("doc_id") * 1_000_000 + F.col("place")).alias("seq_idx"), _gapped(F.col("w"), F.col("doc_id")).alias("sequence"))


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msa_id, seq_idx, sequence): whole documents, those of a source as one family."""
    return seqs(spark, sf_dir).select(F.col("source").alias("msa_id"), F.col("doc_id").alias("seq_idx"), _gapped(F.col("seq"), F.col("doc_id")).alias("sequence"))


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_name, ref_sequence): one row."""
    return references(spark, sf_dir).where(F.col("key") == REFERENCE_KEY).drop("key")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, ref_name, ref_sequence): the names of all regions."""
    return read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("ref_name"), derived_sequence("r_name").alias("ref_sequence"))


def _spell(text: str) -> str:
    return f"regexp_replace(upper(regexp_replace({text}, '[^A-Za-z]', '', 'g')), '[JOUZ]', '', 'g')"


SEQS = f"seqs AS (SELECT * FROM (SELECT doc_id, lang, source, {_spell('text')} AS seq FROM documents) WHERE seq <> '')"
#: Every residue of every document, i from 1.
LETTERS = f"{SEQS}, letters AS (SELECT doc_id, lang, unnest(l) AS aa, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, lang, string_split(seq, '') AS l FROM seqs))"
MSA = """words AS (SELECT doc_id, lang, i - 1 AS place, regexp_replace(upper(w), '[JOUZ]', '', 'g') AS w FROM (SELECT doc_id, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, lang, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents))),
msa AS (SELECT concat_ws('-', lang, length(w)::VARCHAR) AS msa_id, doc_id * 1000000 + place AS seq_idx, CASE WHEN doc_id % 5 = 0 THEN replace(w, 'A', '-') ELSE w END AS sequence FROM words WHERE w <> '')"""
COLS = f"{MSA}, cols AS (SELECT msa_id, seq_idx, (i - 1)::INT AS pos, substr(sequence, i, 1) AS aa FROM (SELECT *, unnest(range(1, length(sequence) + 1)) AS i FROM msa)), cnt AS (SELECT msa_id, pos, aa, count(*) AS c FROM cols GROUP BY ALL), sz AS (SELECT msa_id, count(*) AS n, min(length(sequence))::INT AS width FROM msa GROUP BY 1)"
FAMILIES = f"{SEQS}, fam AS (SELECT source AS msa_id, doc_id AS seq_idx, CASE WHEN doc_id % 5 = 0 THEN replace(seq, 'A', '-') ELSE seq END AS sequence FROM seqs)"
REFS = f"refs AS (SELECT r_regionkey AS key, r_name AS ref_name, {_spell('r_name')} AS s FROM region)"
SCORES = "[" + ",".join(str(int(x)) for x in blosum62().lookup().reshape(-1)) + "]"


def cell(a: str, b: str) -> str:
    return f"{SCORES}[(instr('{ALPHABET}', {a}) - 1) * 24 + instr('{ALPHABET}', {b})]"


def dp_rows(local: bool, edge: int = -1, band: int | None = None, gap: int = -1, simple: tuple[int, int] | None = None, of: str = f"WHERE key = {REFERENCE_KEY}") -> str:
    """WITH clauses that end in r: a row for each cell (doc_id, ref_name, m, n, i, j, h) of every document's matrix with the references.

    A step of the recursion is a column of the reference; the best way in along the document is a running maximum.
    """
    none = -(1 << 30)
    pair = f"CASE WHEN c = substr(s, j + 1, 1) THEN {simple[0]} ELSE {simple[1]} END" if simple else f"{SCORES}[(a - 1) * 24 + instr('{ALPHABET}', substr(s, j + 1, 1))]"
    low = "0" if local else str(none)
    inside = lambda col: "true" if band is None else f"(NOT banded OR abs(i - ({col})) <= {band})"
    at_zero = "0" if local else f"CASE WHEN {inside('0')} THEN i * {edge} ELSE {none} END"
    border = "0" if local else f"(CASE WHEN {inside('j + 1')} THEN (j + 1) * {edge} ELSE {none} END)"
    step = f"greatest({low}, lag(h) OVER w + {pair}, h + {gap})"
    return f"""
WITH RECURSIVE {SEQS}, {REFS},
ch AS (SELECT doc_id, i, c, instr('{ALPHABET}', c)::INT AS a, len(l)::INT AS m FROM (SELECT doc_id, l, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(seq, '') AS l FROM seqs))),
p AS (SELECT *, m * 1.0 / length(s) BETWEEN 0.5 AND 2 AS banded, length(s)::INT AS n FROM (SELECT * FROM ch UNION ALL SELECT DISTINCT doc_id, 0, '', 0, m FROM ch), (SELECT * FROM refs {of})),
r AS (SELECT doc_id, ref_name, s, m, n, banded, i::INT AS i, c, a, 0 AS j, ({at_zero})::INT AS h FROM p
UNION ALL SELECT doc_id, ref_name, s, m, n, banded, i, c, a, j + 1, (CASE WHEN {inside('j + 1')} THEN greatest({low}, g) ELSE {low} END)::INT FROM (
  SELECT *, max(t - ({gap}) * i) OVER (PARTITION BY doc_id, ref_name ORDER BY i) + ({gap}) * i AS g FROM (
    SELECT *, CASE WHEN i = 0 THEN {border} WHEN NOT {inside('j + 1')} THEN {low} ELSE {step} END AS t FROM r WHERE j < n WINDOW w AS (PARTITION BY doc_id, ref_name ORDER BY i))))"""


def dp_sql(local: bool, edge: int = -1, band: int | None = None, gap: int = -1, simple: tuple[int, int] | None = None) -> str:
    """doc_id and score of every document against the reference."""
    best = "max(h)" if local else "max(h) FILTER (WHERE i = m AND j = n)"
    return f"{dp_rows(local, edge, band, gap, simple)} SELECT doc_id, {best}::INT AS score FROM r GROUP BY doc_id"


def ends_sql() -> str:
    """doc_id, score and ends of the best local alignment with the reference; of several the one in the first column, then the first row."""
    return f"{dp_rows(True)}, b AS (SELECT doc_id, max({{'h': h, 'j': -j, 'i': -i}}) AS b FROM r GROUP BY doc_id) SELECT doc_id, b.h AS score, (-b.i)::INT AS q_end, (-b.j)::INT AS s_end FROM b"

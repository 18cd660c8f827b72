"""Text formats of sequences and hits: readers as scans and expressions, writers as line expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File suffixes, the header of tabular hits, the width of wrapped sequences.
SUFFIXES = {"fasta": "fasta", "fa": "fasta", "faa": "fasta", "fastq": "fastq", "fq": "fastq", "tsv": "tsv", "txt": "tsv"}
TABULAR_HEADER = "# Fields: query, subject, pident, length, mismatch, gapopen, qstart, qend, sstart, send, evalue, bitscore"
WIDTH = 70


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_of(path: Column | str) -> Column:
    """fasta, fastq or tsv by a path's suffix; fasta if it is another."""
    suffix = F.lower(F.regexp_extract(_col(path), r"\.([^./]+)$", 1))
    table = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))
    return F.coalesce(table[suffix], F.lit("fasta"))


def fasta_records(records: DataFrame, value: str = "value", whole_header: bool = False) -> DataFrame:
    """(id, description, sequence) from texts that hold one record each, with or without its leading >; sequence lines are joined. whole_header: the header line is the id, without a description."""
    body = F.regexp_replace(F.regexp_replace(value, r"^>", ""), "\r", "")
    rows = records.select(body.alias("body")).where(F.trim("body") != "")
    head, rest = F.substring_index("body", "\n", 1), F.when(F.instr("body", "\n") > 0, F.substring(F.col("body"), F.instr("body", "\n") + 1, F.length("body"))).otherwise("")
    space = F.lit(0) if whole_header else F.instr(head, " ")
    return rows.select(
        F.when(space > 0, F.substring(head, F.lit(1), space - 1)).otherwise(head).alias("id"),
        F.when(space > 0, F.substring(head, space + 1, F.length(head))).alias("description"),
        F.regexp_replace(rest, r"\s", "").alias("sequence"),
    )


def read_fasta(spark: SparkSession, path: str, whole_header: bool = False) -> DataFrame:
    """FASTA files of any size: a record is what stands between line starts with >, so files are split between tasks."""
    return fasta_records(spark.read.option("lineSep", "\n>").text(path), whole_header=whole_header)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, sequence, quality, error) of files whose records are four lines; each file is read whole, as its lines can't be told apart by themselves."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.rtrim(F.regexp_replace("value", "\r", "")), "\n").alias("l"))
    rows = lines.select(F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.size("l") / 4).cast("int") - 1), lambda i: F.slice("l", i * 4 + 1, 4))).alias("r")).where((F.size("r") > 1) | (F.get("r", F.lit(0)) != ""))
    at = lambda k: F.get("r", F.lit(k))
    head = F.regexp_replace(at(0), "^@", "")
    error = F.when(F.size("r") < 4, "truncated").when(~F.startswith(at(0), F.lit("@")), "header").when(at(2) != "+", "separator").when(F.length(at(1)) != F.length(at(3)), "quality")
    return rows.select(F.substring_index(head, " ", 1).alias("id"), F.when(F.instr(head, " ") > 0, F.regexp_replace(head, "^[^ ]* ", "")).alias("description"), at(1).alias("sequence"), at(3).alias("quality"), error.alias("error"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(id, sequence, description, quality) of tab-separated lines; lines of one field have an error."""
    parts = spark.read.text(path).where("value <> ''").select(F.split("value", "\t").alias("p"))
    at = lambda k: F.get("p", F.lit(k))
    return parts.select(at(0).alias("id"), at(1).alias("sequence"), at(2).alias("description"), at(3).alias("quality"), F.when(F.size("p") < 2, "too few fields").alias("error"))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """By the path's suffix; id, description, sequence and quality whatever the format."""
    suffix = path.rsplit(".", 1)[-1].lower()
    found = {"fastq": read_fastq, "tsv": read_tsv}.get(SUFFIXES.get(suffix, "fasta"), read_fasta)(spark, path)
    return found.select(*(found[c] if c in found.columns else F.lit(None).cast("string").alias(c) for c in ("id", "description", "sequence", "quality")))


def wrap(sequence: Column | str, width: int = WIDTH) -> Column:
    return F.regexp_replace(_col(sequence), f"(.{{{width}}})(?=.)", "$1\n")


def fasta_text(header: Column | str, sequence: Column | str) -> Column:
    return F.concat(F.lit(">"), _col(header), F.lit("\n"), wrap(sequence))


def fastq_text(name: Column | str, sequence: Column | str, quality: Column | str) -> Column:
    """Null without quality."""
    return F.concat(F.lit("@"), _col(name), F.lit("\n"), _col(sequence), F.lit("\n+\n"), _col(quality))


def tsv_text(*columns: Column | str) -> Column:
    return F.array_join(F.array(*(F.coalesce(_col(c).cast("string"), F.lit("")) for c in columns)), "\t")


def scientific(x: Column | str) -> Column:
    """Shortest mantissa and exponent, as 1e-30 or 2.5e2."""
    x = _col(x)
    text = F.format_string("%.15e", x)
    mantissa = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)e", 1), r"0+$", ""), r"\.$", "")
    exponent = F.regexp_extract(text, r"e([+-]\d+)$", 1).cast("int").cast("string")
    return F.when(x == 0, "0e0").otherwise(F.concat(mantissa, F.lit("e"), exponent))


HIT = "query_name subject_name percent_identity alignment_length mismatches gap_opens query_start query_end subject_start subject_end evalue bit_score".split()


def blast_tabular() -> Column:
    """A line of tabular output from columns named as in HIT."""
    shown = {"percent_identity": F.format_string("%.1f", "percent_identity"), "evalue": scientific("evalue"), "bit_score": F.format_string("%.1f", "bit_score")}
    return F.concat_ws("\t", *(shown.get(c, F.col(c).cast("string")) for c in HIT))


def blast_json() -> Column:
    order = ["query_name", "subject_name", "score", "evalue", "bit_score", *HIT[2:10]]
    return F.to_json(F.struct(*order))


def blast_xml() -> Column:
    inner = F.concat(F.lit("<Hsp_score>"), F.col("score").cast("string"), F.lit("</Hsp_score><Hsp_evalue>"), scientific("evalue"), F.lit("</Hsp_evalue>"))
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><BlastOutput><BlastOutput_query-def>'), esc("query_name"),
        F.lit("</BlastOutput_query-def><BlastOutput_iterations><Iteration><Iteration_hits><Hit><Hit_def>"), esc("subject_name"),
        F.lit("</Hit_def><Hit_hsps><Hsp>"), inner, F.lit("</Hsp></Hit_hsps></Hit></Iteration_hits></Iteration></BlastOutput_iterations></BlastOutput>"),
    )


def gff3_line() -> Column:
    """From seq_id, source, feature, start, end, score, strand, phase, attrs (array of (k, v)); null where start is beyond end."""
    attrs = F.array_join(F.transform("attrs", lambda a: F.concat_ws("=", a["k"], a["v"])), ";")
    dot = lambda c: F.coalesce(c, F.lit("."))
    shown = F.when(F.col("score").isNotNull(), F.format_string("%.1f", "score")).otherwise(".")
    line = F.concat_ws("\t", "seq_id", dot(F.col("source")), "feature", F.col("start").cast("string"), F.col("end").cast("string"), shown, dot(F.col("strand")), dot(F.col("phase")), F.when(F.coalesce(attrs, F.lit("")) == "", ".").otherwise(attrs))
    return F.when(F.col("start") <= F.col("end"), line)


def sam_line(name: Column | str, reference: Column | str, start: Column | str, cigar: Column | str, aligned_query: Column | str, score: Column | str) -> Column:
    """A record of an alignment: position start + 1, quality 60, the score as AS."""
    return F.concat_ws("\t", _col(name), F.lit("0"), _col(reference), (_col(start) + 1).cast("string"), F.lit("60"), _col(cigar), F.lit("*\t0\t0"), F.replace(_col(aligned_query), F.lit("-"), F.lit("")), F.lit("*"), F.concat(F.lit("AS:i:"), _col(score).cast("string")))


def sam_header(references: list[tuple[str, int]], version: str = "1.6", sort_order: str = "unsorted", program: tuple[str, str] | None = None) -> list[str]:
    lines = [f"@HD\tVN:{version}" + (f"\tSO:{sort_order}" if sort_order != "unsorted" else "")]
    if program:
        lines.append(f"@PG\tID:{program[0]}\tPN:{program[0]}\tVN:{program[1]}")
    return lines + [f"@SQ\tSN:{n}\tLN:{size}" for n, size in references]


def write_lines(rows: DataFrame, line: Column, path: str, mode: str = "error") -> None:
    rows.select(line.alias("value")).where("value is not null").write.mode(mode).text(path)

"""Queries of text formats and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from strandloom.sources import models, text
from strandloom.plans.views import SEQS, read, seqs


def fasta_lines(spark, d):
    rows = seqs(spark, d)
    return rows.select("doc_id", text.fasta_text(F.concat_ws(" ", F.concat(F.lit("doc"), F.col("doc_id").cast("string")), "lang"), "seq").alias("record"))


def fasta_round_trip(spark, d):
    records = fasta_lines(spark, d)
    return text.fasta_records(records, "record")


def fastq_lines(spark, d):
    rows = seqs(spark, d)
    return rows.select("doc_id", text.fastq_text(F.col("doc_id").cast("string"), "seq", F.when(F.col("doc_id") % 7 != 0, F.repeat(F.lit("I"), F.length("seq")))).alias("record"), text.tsv_text("doc_id", "seq", "lang").alias("line"))


def _hits(spark, d):
    l = read(spark, d, "lineitem")
    return l.select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("q"), F.col("l_partkey").cast("string")).alias("query_name"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("subject_name"), (F.col("l_quantity") * 10).cast("int").alias("score"),
        (F.col("l_quantity") * 1e-5).alias("evalue"), (F.col("l_quantity") / 2).alias("bit_score"), (100 - F.col("l_linenumber") * 1.5).alias("percent_identity"), F.col("l_quantity").cast("int").alias("alignment_length"), F.col("l_linenumber").alias("mismatches"),
        F.lit(0).alias("gap_opens"), F.lit(1).alias("query_start"), F.col("l_quantity").cast("int").alias("query_end"), F.col("l_linenumber").alias("subject_start"), (F.col("l_linenumber") + F.col("l_quantity")).cast("int").alias("subject_end"),
    )


def blast_tabular_lines(spark, d):
    rows = _hits(spark, d).withColumn("evalue", F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.lit(10.0) * F.pow(F.lit(2.0), F.col("l_linenumber"))))
    return rows.select("l_orderkey", "l_linenumber", text.blast_tabular().alias("line"))


def blast_json_fields(spark, d):
    """JSON records read back: what a reader finds in them."""
    j = _hits(spark, d).select("l_orderkey", "l_linenumber", text.blast_json().alias("j"))
    got = F.from_json("j", "query_name string, subject_name string, score int, subject_end int, gap_opens int")
    return j.select("l_orderkey", "l_linenumber", got["query_name"].alias("q"), got["score"].alias("score"), got["subject_end"].alias("subject_end"), got["gap_opens"].alias("gap_opens"))


def blast_xml_fields(spark, d):
    x = _hits(spark, d).withColumn("evalue", F.lit(2.5e-7)).select("l_orderkey", "l_linenumber", text.blast_xml().alias("x"))
    return x.select("l_orderkey", "l_linenumber", F.regexp_extract("x", "<Hit_def>(.*)</Hit_def>", 1).alias("hit"), F.regexp_extract("x", "<Hsp_score>(.*)</Hsp_score>", 1).alias("score"), F.regexp_extract("x", "<Hsp_evalue>(.*)</Hsp_evalue>", 1).alias("evalue"))


def gff3_lines(spark, d):
    l = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("alignment").alias("source"), F.concat(F.lit("chr"), F.col("l_linenumber").cast("string")).alias("seq_id"), F.lit("match").alias("feature"), F.col("l_suppkey").alias("start"), F.col("l_partkey").alias("end"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("score"), F.when(F.col("l_linenumber") == 1, "+").alias("strand"), F.lit(None).cast("string").alias("phase"), F.when(F.col("l_linenumber") > 2, F.array(F.struct(F.lit("ID").alias("k"), F.col("l_orderkey").cast("string").alias("v")), F.struct(F.lit("line").alias("k"), F.col("l_linenumber").cast("string").alias("v")))).alias("attrs"))
    return l.select("l_orderkey", "l_linenumber", text.gff3_line().alias("line"))


def sam_lines(spark, d):
    rows = seqs(spark, d)
    return rows.select("doc_id", text.sam_line(F.concat(F.lit("read"), F.col("doc_id").cast("string")), F.lit("ref"), F.col("doc_id") % 1000, F.concat(F.length("seq").cast("string"), F.lit("=")), F.replace("seq", F.lit("A"), F.lit("A-")), F.length("seq")).alias("line"))


def format_names(spark, d):
    pages = read(spark, d, "pages").select("page_id", F.concat("url", F.element_at(F.array(*(F.lit(x) for x in (".fa", ".FASTQ", ".fq", ".tsv", ".txt", ".faa", "", ".bin"))), (F.col("page_id") % 8 + 1).cast("int"))).alias("path"))
    return pages.select("page_id", text.format_of("path").alias("format"))


def _model_text(spark, d):
    p = read(spark, d, "part")
    n = F.col("p_partkey").cast("string")
    return p.select("p_partkey", F.concat(F.lit("HMMER3/f\nNAME  fam"), n, F.lit("\nACC   PF"), n, F.lit(".1\nDESC  "), F.col("p_name"), F.lit("\nLENG  "), F.col("p_size").cast("string"), F.lit("\nALPH  amino\n"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("GA    "), F.col("p_size").cast("string"), F.lit(".5 "), F.col("p_size").cast("string"), F.lit(".5;\n"))).otherwise("")).alias("value"))


def model_headers(spark, d):
    return models.model_headers(_model_text(spark, d)).select("name", "accession", "description", "length", "alphabet", "ga", "tc")


def model_formats(spark, d):
    head = F.element_at(F.array(*(F.lit(x) for x in ("HMMER3/f\nNAME x", "# STOCKHOLM 1.0\n#=GF AC PF1", "# hmmsearch :: search", "ID IPR000001", "nothing"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", models.detect_format(head).alias("format"))


def score_tokens(spark, d):
    shapes = [F.lit("*"), F.lit("-inf"), F.concat(F.lit("*-"), F.col("l_partkey").cast("string")), (F.col("l_quantity") / 100).cast("string"), F.concat(F.lit("-"), (F.col("l_partkey") + 1000).cast("string")), F.col("l_quantity").cast("string"), F.lit("x1")]
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(F.array(*shapes), ((F.col("l_orderkey") + F.col("l_linenumber")) % 7 + 1).cast("int")).alias("t"))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.nanvl(F.when(models.score_token("t") == float("-inf"), -1e308).otherwise(models.score_token("t")), F.lit(None)), 6).alias("score"))


def bam_round_trip(spark, d):
    """Records packed into bytes and read back."""
    from strandloom.sources.bam import pack, packed_records, unpack

    s = seqs(spark, d)
    rows = s.select("doc_id", F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("name"), F.lit(0).alias("flag"), F.lit(0).alias("ref_id"), (F.col("doc_id") % 1000).cast("int").alias("pos"), F.lit(60).alias("mapq"), F.concat(F.lit("2S"), (F.length("seq") + 1).cast("string"), F.lit("M")).alias("cigar"), F.translate("seq", "ARNDCEQGHILKMFPSTWYVBX", "ACGTACGTACGTACGTACGTNN").alias("sequence"), F.repeat(F.lit("I"), F.length("seq")).alias("quality"))

    @F.pandas_udf("name string, pos int, cigar string, sequence string, quality string")
    def back(p: pd.Series) -> pd.DataFrame:
        got = [unpack(pack([("ref", 1000)], [bytes(x)]))[2][0] for x in p]
        return pd.DataFrame(got, columns=["name", "pos", "cigar", "sequence", "quality"])

    return packed_records(rows).select("doc_id", back("packed").alias("b")).select("doc_id", "b.*")


def model_fields(spark, d):
    """The same family written in four formats, read back."""
    n, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    lit = F.lit
    texts = [
        F.concat(lit("HMMER3/f\nNAME  fam"), n, lit("\nACC   PF"), n, lit("\nLENG  "), size, lit("\n")),
        F.concat(lit("# STOCKHOLM 1.0\n#=GF ID   fam"), n, lit("\n#=GF AC   PF"), n, lit("\n#=GF LEN  "), size, lit("\n")),
        F.concat(lit("# hmmsearch :: x\nQuery:       fam"), n, lit("  [M="), size, lit("]\nAccession:   PF"), n, lit("\n")),
        F.concat(lit("ID   IPR"), F.lpad(n, 6, "0"), lit("\nAC   PF"), n, lit("\nDE   none\n")),
    ]
    rows = read(spark, d, "part").select("p_partkey", models.any_model(F.element_at(F.array(*texts), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("m"))
    return rows.select("p_partkey", "m.format", "m.name", "m.accession", "m.length")


def model_lookup(spark, d):
    """Models of a database by accession: a semi-join with the wanted keys."""
    wanted = read(spark, d, "supplier").select(F.concat(F.lit("PF"), F.col("s_suppkey").cast("string"), F.lit(".1")).alias("accession"))
    return model_headers(spark, d).join(wanted, "accession", "left_semi").select("name", "length")


def interchange_round_trip(spark, d):
    from strandloom.operators.interchange import protein_record, protein_sequence

    rows = seqs(spark, d)
    return protein_sequence(protein_record(rows, "doc_id", "seq")).select(F.col("id").cast("long").alias("doc_id"), "sequence", "error")


QUERIES = {f.__name__: f for f in (fasta_lines, fasta_round_trip, fastq_lines, blast_tabular_lines, blast_json_fields, blast_xml_fields, gff3_lines, sam_lines, format_names, model_headers, model_fields, model_lookup, interchange_round_trip, model_formats, score_tokens, bam_round_trip)}
_E = "CASE l_linenumber WHEN 1 THEN '0e0' WHEN 2 THEN '4e1' WHEN 3 THEN '8e1' WHEN 4 THEN '1.6e2' WHEN 5 THEN '3.2e2' WHEN 6 THEN '6.4e2' ELSE '1.28e3' END"
_Q = "CAST(l_quantity AS INT)"
SQL = {
    "fasta_lines": f"WITH {SEQS} SELECT doc_id, '>doc' || doc_id || ' ' || lang || chr(10) || rtrim(regexp_replace(seq, '(.{{70}})', '\\1' || chr(10), 'g'), chr(10)) AS record FROM seqs",
    "fasta_round_trip": f"WITH {SEQS} SELECT 'doc' || doc_id AS id, lang AS description, seq AS sequence FROM seqs",
    "fastq_lines": f"WITH {SEQS} SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN '@' || doc_id || chr(10) || seq || chr(10) || '+' || chr(10) || repeat('I', length(seq)) END AS record, doc_id || chr(9) || seq || chr(9) || lang AS line FROM seqs",
    "blast_tabular_lines": f"SELECT l_orderkey, l_linenumber, concat_ws(chr(9), 'q' || l_partkey, 's' || l_suppkey, printf('%.1f', (100 - l_linenumber * 1.5)::DOUBLE), {_Q}, l_linenumber, 0, 1, {_Q}, l_linenumber, CAST(l_linenumber + l_quantity AS INT), {_E}, printf('%.1f', l_quantity / 2)) AS line FROM lineitem",
    "blast_json_fields": f"SELECT l_orderkey, l_linenumber, 'q' || l_partkey AS q, CAST(l_quantity * 10 AS INT) AS score, CAST(l_linenumber + l_quantity AS INT) AS subject_end, 0 AS gap_opens FROM lineitem",
    "blast_xml_fields": "SELECT l_orderkey, l_linenumber, 's' || l_suppkey AS hit, CAST(l_quantity * 10 AS INT)::VARCHAR AS score, '2.5e-7' AS evalue FROM lineitem",
    "gff3_lines": "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey <= l_partkey THEN concat_ws(chr(9), 'chr' || l_linenumber, 'alignment', 'match', l_suppkey, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN printf('%.1f', l_quantity) ELSE '.' END, CASE WHEN l_linenumber = 1 THEN '+' ELSE '.' END, '.', CASE WHEN l_linenumber > 2 THEN 'ID=' || l_orderkey || ';line=' || l_linenumber ELSE '.' END) END AS line FROM lineitem",
    "sam_lines": f"WITH {SEQS} SELECT doc_id, concat_ws(chr(9), 'read' || doc_id, '0', 'ref', doc_id % 1000 + 1, '60', length(seq) || '=', '*', '0', '0', seq, '*', 'AS:i:' || length(seq)) AS line FROM seqs",
    "format_names": "SELECT page_id, ['fasta', 'fastq', 'fastq', 'tsv', 'tsv', 'fasta', 'fasta', 'fasta'][page_id % 8 + 1] AS format FROM pages",
    "model_headers": "SELECT 'fam' || p_partkey AS name, 'PF' || p_partkey || '.1' AS accession, p_name AS description, p_size AS length, 'amino' AS alphabet, CASE WHEN p_partkey % 2 = 0 THEN p_size + 0.5::DOUBLE END AS ga, NULL::DOUBLE AS tc FROM part",
    "model_fields": "SELECT p_partkey, ['HMMER3', 'STOCKHOLM', 'HMMSEARCH', 'INTERPRO'][p_partkey % 4 + 1] AS format, CASE WHEN p_partkey % 4 = 3 THEN 'IPR' || lpad(p_partkey::VARCHAR, 6, '0') ELSE 'fam' || p_partkey END AS name, 'PF' || p_partkey AS accession, CASE WHEN p_partkey % 4 <> 3 THEN p_size END AS length FROM part",
    "model_lookup": "SELECT 'fam' || p_partkey AS name, p_size AS length FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier)",
    "interchange_round_trip": f"WITH {SEQS} SELECT doc_id, seq AS sequence, NULL::VARCHAR AS error FROM seqs",
    "model_formats": "SELECT p_partkey, ['HMMER3', 'STOCKHOLM', 'HMMSEARCH', 'INTERPRO', NULL][p_partkey % 5 + 1] AS format FROM part",
    "score_tokens": "WITH r AS (SELECT *, (l_orderkey + l_linenumber) % 7 AS k FROM lineitem) SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN -1e308 WHEN 1 THEN -1e308 WHEN 2 THEN round(-l_partkey / 1000.0, 6) WHEN 3 THEN round(ln((l_quantity / 100) / (1 - l_quantity / 100)), 6) WHEN 4 THEN round(CASE WHEN l_partkey + 1000 > 1000 THEN -(l_partkey + 1000) / 1000.0 ELSE -1000 END, 6) WHEN 5 THEN l_quantity END AS score FROM r",
    "bam_round_trip": f"WITH {SEQS} SELECT doc_id, 'r' || doc_id AS name, (doc_id % 1000)::INT AS pos, '2S' || (length(seq) + 1) || 'M' AS cigar, translate(seq, 'ARNDCEQGHILKMFPSTWYVBX', 'ACGTACGTACGTACGTACGTNN') AS sequence, repeat('I', length(seq)) AS quality FROM seqs",
}

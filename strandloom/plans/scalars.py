"""Queries of residues, matrices, statistics, batches and planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import residues as rs
from strandloom.functions import statistics as st
from strandloom.operators import batches
from strandloom.operators.matrices import blosum62, validate
from strandloom.plans.views import LETTERS, SCORES, SEQS, cell, read, seqs

_ALPHA = rs.ALPHABET
#: Residues that a read has at least.
LEAST_LENGTH = 24


def residue_histogram(spark, d):
    """How often each residue stands in each language, with its places in the alphabets and its long name."""
    letters = seqs(spark, d).select("lang", F.explode(F.split("seq", "")).alias("aa")).where("aa <> ''")
    n = letters.groupBy("lang", "aa").agg(F.count(F.lit(1)).alias("n"))
    i = rs.aa_index("aa")
    return n.select("lang", "aa", "n", i.alias("idx"), rs.bridge_index("aa").alias("bridge"), rs.parsimony_index("aa").alias("parsimony"), rs.nucleotide_index("aa").alias("nucleotide"), rs.aa_code(i).alias("back"), rs.three_letter(rs.bridge_index("aa")).alias("long_name"))


def parsed_sequences(spark, d):
    """Names as sequences: white space gone, validated."""
    raw = read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("s")).unionByName(read(spark, d, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.concat(F.lit(" "), "r_name", F.lit("\t")).alias("s")))
    return raw.select("n_nationkey", rs.parse_sequence("s").alias("sequence"), rs.parse_error("s").alias("error"), F.length(rs.parse_sequence("s")).alias("size"))


def matrix_cells(spark, d):
    return blosum62().frame(spark).select("aa1", "aa2", "score")


def matrix_checks(spark, d):
    return validate(blosum62().frame(spark))


def pair_scores(spark, d):
    """Ungapped score of each sequence and its reverse: a join with the matrix, which has 576 rows. Rows of a document stand together, so sums are combined before the shuffle."""
    one = F.filter(F.split("seq", ""), lambda c: c != "")
    pairs = F.zip_with(one, F.reverse(one), lambda x, y: F.struct(x.alias("aa1"), y.alias("aa2")))
    at = seqs(spark, d).select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.*")
    return at.join(F.broadcast(blosum62().frame(spark).select("aa1", "aa2", "score")), ["aa1", "aa2"]).groupBy("doc_id").agg(F.sum("score").alias("score"))


def score_statistics(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("s"))
    bits = st.karlin_bits("s")
    return rows.select(
        "l_orderkey", "l_linenumber", F.round(bits, 6).alias("bits"), F.round(F.log10(st.karlin_evalue("s", 1e6)), 6).alias("log_e"), F.round(F.log10(st.profile_evalue("s")), 6).alias("log_e_profile"),
        F.round(F.log10(st.pfam_evalue("s", 1e6)), 6).alias("log_e_pfam"), F.round(st.pfam_bits("s"), 6).alias("pfam_bits"), F.round(F.log10(st.pfam_pvalue("s")), 6).alias("log_p"), F.round(st.pfam_bits("s", st.PFAM_NUCLEOTIDE), 6).alias("nt_bits"),
        st.passes("s", F.when(F.col("l_linenumber") > 3, F.lit(25.0))).alias("passes"),
    )


def node_stats(spark, d):
    """Totals of tasks by worker: counts, shares and mean times."""
    tasks = read(spark, d, "orders").select((F.col("o_custkey") % 16).alias("node"), F.when(F.col("o_custkey") % 16 == 3, "Offline").when(F.col("o_orderstatus") == "O", "Busy").otherwise("Idle").alias("status"), (F.col("o_totalprice") / 1000).alias("ms"))
    return batches.node_statistics(tasks)


def contiguous_batches(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("task"), "o_custkey")
    return batches.contiguous(o, "task", 7).join(batches.round_robin(o, "task", 4).select("task", "device"), "task").select("task", "batch", "device")


def tiles(spark, d):
    pairs = read(spark, d, "part").select("p_partkey", (F.col("p_size") * 5).alias("m"), (F.col("p_partkey") % 97 + 1).alias("n"))
    return batches.tiles(pairs, "m", "n", 32).select("p_partkey", "tile_row", "tile_col", "raster", "height", "width")


def chunked_reads(spark, d):
    """Sequences of a least length in chunks of a fixed size, in order."""
    return batches.chunks(seqs(spark, d).where(F.length("seq") >= LEAST_LENGTH), "doc_id", 64).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def tiling_statistics(spark, d):
    pairs = read(spark, d, "part").select("p_partkey", (F.col("p_size") * 5).alias("m"), (F.col("p_partkey") % 97 + 1).alias("n"))
    return batches.tiling_statistics(pairs, "m", "n", "A100").select("p_partkey", "tiles", "tile_bytes", "beneficial", F.round("estimated_ms", 9).alias("estimated_ms"), batches.stream_chunk(F.col("m")).alias("chunk"))


def dna_round_trip(spark, d):
    """Whole documents as nucleotide codes and back: what isn't a base is N."""
    from strandloom.operators.interchange import dna_record, dna_sequence, flagged

    rows = dna_sequence(dna_record(seqs(spark, d), "doc_id", "seq"))
    rows = flagged(rows, F.when(F.instr("sequence", "NNNN") == 0, F.lit("bases")))
    return rows.select(F.col("id").cast("long").alias("doc_id"), "sequence", "clinically_significant")


def alignment_records(spark, d):
    """Records of alignments whose rows are a document's residues, with gaps for A on one side and for E on the other."""
    from strandloom.functions import cigar
    from strandloom.operators.interchange import alignment_record

    rows = seqs(spark, d).select("doc_id", "lang", F.replace("seq", F.lit("A"), F.lit("-")).alias("aligned_query"), F.replace("seq", F.lit("E"), F.lit("-")).alias("aligned_subject"), (F.col("doc_id") % 300).cast("int").alias("score"))
    rows = rows.withColumn("cigar", cigar.to_text(cigar.from_aligned("aligned_query", "aligned_subject")))
    out = alignment_record(rows, "doc_id", "lang")
    return out.select("query_id", "subject_id", F.round("bit_score", 6).alias("bit_score"), F.round(F.log10("evalue"), 6).alias("log_e"), F.round("identity", 6).alias("identity"), "query_end", "subject_end", "matches", "gaps")


def interchange_records(spark, d):
    from strandloom.operators.interchange import dna_record, protein_record

    rows = seqs(spark, d)
    p = protein_record(rows, "doc_id", "seq").select(F.col("id").cast("long").alias("doc_id"), F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"), F.col("metadata")["database"].alias("db"), F.col("metadata")["taxon"].alias("taxon"))
    n = dna_record(rows, "doc_id", "seq").select(F.col("id").cast("long").alias("doc_id"), F.array_join(F.transform("codes", lambda c: c.cast("string")), "").alias("dna"))
    return p.join(n, "doc_id")


_LOG_K, _L, _K = st.KARLIN["log_k"], st.KARLIN["lambda"], st.KARLIN["k"]
_E = f"log10({_K} * {{n}} * exp(-{_L} * ((s * ln(2) + {_LOG_K}) / {_L})))"
QUERIES = {f.__name__: f for f in (residue_histogram, parsed_sequences, matrix_cells, matrix_checks, pair_scores, score_statistics, node_stats, contiguous_batches, tiles, chunked_reads, tiling_statistics, dna_round_trip, alignment_records, interchange_records)}
_IDX = lambda a, miss="NULL": f"(CASE WHEN instr('{a}', aa) > 0 THEN instr('{a}', aa) - 1 ELSE {miss} END)::INT"
_LONG = "[" + ", ".join(f"'{x}'" for x in rs.THREE_LETTER) + "]"
_RAW = "raw AS (SELECT n_nationkey, n_name AS s FROM nation UNION ALL SELECT r_regionkey + 100, ' ' || r_name || chr(9) FROM region), p AS (SELECT n_nationkey, upper(regexp_replace(s, '\\s', '', 'g')) AS u FROM raw), v AS (SELECT *, regexp_matches(u, '^[ARNDCEQGHILKMFPSTWYVBX*\\-]+$') AS ok FROM p)"
SQL = {
    "tiling_statistics": "WITH p AS (SELECT p_partkey, p_size * 5 AS m, p_partkey % 97 + 1 AS n, ceil(p_size * 5 / 32)::BIGINT * ceil((p_partkey % 97 + 1) / 32)::BIGINT AS tiles FROM part) SELECT p_partkey, tiles, tiles * 4624 AS tile_bytes, tiles * 4624 < 536870912 AS beneficial, round((m + 1) * (n + 1) / 1e6, 9) AS estimated_ms, greatest(100, floor(m * 1048576 / 1000))::BIGINT AS chunk FROM p",
    "dna_round_trip": f"WITH {SEQS}, n AS (SELECT doc_id, regexp_replace(seq, '[^ACGT]', 'N', 'g') AS sequence FROM seqs) SELECT doc_id, sequence, instr(sequence, 'NNNN') = 0 AS clinically_significant FROM n",
    "alignment_records": f"WITH {LETTERS}, n AS (SELECT doc_id, lang, count(*) AS n, sum((aa = 'A')::INT) AS a, sum((aa = 'E')::INT) AS e FROM letters GROUP BY 1, 2), s AS (SELECT *, ({_L} * (doc_id % 300) + {-_LOG_K}) / ln(2) AS s FROM n) SELECT doc_id::VARCHAR AS query_id, lang AS subject_id, round(greatest(s, 0), 6) AS bit_score, round({_E.format(n='1e6')}, 6) AS log_e, CASE WHEN n > a THEN 1.0::DOUBLE ELSE 0 END AS identity, (n - a + 1)::INT AS query_end, (n - e + 1)::INT AS subject_end, (n - a)::INT AS matches, a::INT AS gaps FROM s",
    "residue_histogram": f"WITH {LETTERS} SELECT lang, aa, count(*) AS n, {_IDX(_ALPHA)} AS idx, {_IDX(rs.BRIDGE_ALPHABET)} AS bridge, {_IDX(rs.ALPHABETICAL, '20')} AS parsimony, {_IDX(rs.NUCLEOTIDES, '4')} AS nucleotide, aa AS back, {_LONG}[{_IDX(rs.BRIDGE_ALPHABET)} + 1] AS long_name FROM letters GROUP BY lang, aa",
    "parsed_sequences": f"WITH {_RAW} SELECT n_nationkey, CASE WHEN ok THEN u END AS sequence, CASE WHEN u = '' THEN 'EmptySequence' WHEN NOT ok THEN 'InvalidAminoAcid' END AS error, CASE WHEN ok THEN length(u) END::INT AS size FROM v",
    "matrix_cells": f"WITH k AS (SELECT {SCORES} AS m), i AS (SELECT unnest(range(1, 25)) AS i), j AS (SELECT unnest(range(1, 25)) AS j) SELECT substr('{_ALPHA}', i, 1) AS aa1, substr('{_ALPHA}', j, 1) AS aa2, m[(i - 1) * 24 + j]::INT AS score FROM k, i, j",
    "matrix_checks": f"WITH k AS (SELECT unnest({SCORES}) AS s) SELECT 'BLOSUM62' AS matrix, count(*) AS cells, true AS symmetric, min(s)::INT AS low, max(s)::INT AS high, true AS scaled FROM k",
    "pair_scores": f"WITH {LETTERS}, n AS (SELECT doc_id, i, aa, count(*) OVER (PARTITION BY doc_id) AS m FROM letters) SELECT a.doc_id, sum({cell('a.aa', 'b.aa')})::BIGINT AS score FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.i = a.m + 1 - a.i GROUP BY 1",
    "score_statistics": f"WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS s, ({_L} * l_quantity + {-_LOG_K}) / ln(2) AS bits FROM lineitem) SELECT l_orderkey, l_linenumber, round(bits, 6) AS bits, round({_E.format(n='1e6')}, 6) AS log_e, round({_E.format(n='6e9')}, 6) AS log_e_profile, round(log10(0.135 * 1e6 * exp(-s)), 6) AS log_e_pfam, round((0.318 * s - ln(35)) / ln(2), 6) AS pfam_bits, round(log10(exp(-0.318 * s)), 6) AS log_p, round((1.37 * s - ln(38.7)) / ln(2), 6) AS nt_bits, l_linenumber <= 3 OR s >= 25 AS passes FROM s",
    "node_stats": "WITH t AS (SELECT o_custkey % 16 AS node, CASE WHEN o_custkey % 16 = 3 THEN 'Offline' WHEN o_orderstatus = 'O' THEN 'Busy' ELSE 'Idle' END AS status, o_totalprice / 1000 AS ms FROM orders) SELECT node, count(*) AS tasks, bool_or(status <> 'Offline') AS online, sum((status = 'Busy')::INT)::BIGINT AS pending, round(avg(ms), 6) AS mean_ms FROM t GROUP BY 1",
    "contiguous_batches": "WITH r AS (SELECT o_orderkey AS task, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) SELECT task, (r // ((n + 6) // 7))::BIGINT AS batch, (r % 4)::BIGINT AS device FROM r",
    "tiles": "WITH p AS (SELECT p_partkey, p_size * 5 AS m, p_partkey % 97 + 1 AS n FROM part), r AS (SELECT *, unnest(range(0, ((m + 31) // 32)::BIGINT)) AS tile_row FROM p), c AS (SELECT *, unnest(range(0, ((n + 31) // 32)::BIGINT)) AS tile_col FROM r) SELECT p_partkey, tile_row::INT AS tile_row, tile_col::INT AS tile_col, (tile_row * ((n + 31) // 32) + tile_col)::INT AS raster, least(32, m - tile_row * 32)::INT AS height, least(32, n - tile_col * 32)::INT AS width FROM c",
    "chunked_reads": f"WITH {SEQS}, r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM seqs WHERE length(seq) >= {LEAST_LENGTH}) SELECT (r // 64)::BIGINT AS chunk, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM r GROUP BY 1",
    "interchange_records": f"WITH {LETTERS}, a AS (SELECT doc_id, i, instr('{rs.BRIDGE_ALPHABET}', aa) - 1 AS c, CASE WHEN instr('ACGT', aa) > 0 THEN instr('ACGT', aa) - 1 ELSE 4 END AS n FROM letters) SELECT doc_id, string_agg(c::VARCHAR, ',' ORDER BY i) AS codes, 'Ensembl' AS db, '9606' AS taxon, string_agg(n::VARCHAR, '' ORDER BY i) AS dna FROM a GROUP BY 1",
}

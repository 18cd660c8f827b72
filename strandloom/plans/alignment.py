"""Queries of alignment, batches and CIGAR."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import cigar
from strandloom.operators.align import align_pairs, align_to_references, best_hits, filter_by_identity, filter_by_score, scheme, strategy
from strandloom.operators.dp import NONE
from strandloom.operators.matrices import GapPenalty, blosum62, simple
from strandloom.operators.batches import device_memory
from strandloom.plans.views import LETTERS, SEQS, dp_rows, dp_sql, ends_sql, read, reference, references, seqs

LEAST, BAND = 24, 8


def _named(spark, d):
    return seqs(spark, d).select(F.col("doc_id"), F.col("seq").alias("sequence"))


def _scores(local=True, **kw):
    def run(spark, d):
        out = align_to_references(_named(spark, d), reference(spark, d), scheme(**kw), local, trace=False)
        return out.select("doc_id", "alignment.score")

    return run


def sw_top_hits(spark, d):
    """The flagship: best local alignments to one reference; short sequences go before the alignment, low scores after it."""
    out = align_to_references(_named(spark, d), reference(spark, d), trace=False, least_score=LEAST)
    return out.select("doc_id", "alignment.score").orderBy(F.desc("score"), "doc_id")


def sw_alignments(spark, d):
    return align_to_references(_named(spark, d), reference(spark, d)).select("doc_id", "alignment.*")


def nw_alignments(spark, d):
    return align_to_references(_named(spark, d), reference(spark, d), local=False).select("doc_id", "alignment.*")


def sw_alignment_invariants(spark, d):
    """Per document, whether the alignment's CIGAR, spans and clips agree: all must be true."""
    a = align_to_references(_named(spark, d), reference(spark, d))
    ops = cigar.parse("alignment.cigar")
    return a.select(
        "doc_id",
        (cigar.query_length(ops) == F.col("alignment.q_end") - F.col("alignment.q_start")).alias("query_spans"),
        (cigar.reference_length(ops) == F.col("alignment.s_end") - F.col("alignment.s_start")).alias("subject_spans"),
        ((F.col("alignment.clip_left") == F.col("alignment.q_start")) & (F.col("alignment.clip_right") == F.length("sequence") - F.col("alignment.q_end"))).alias("clips"),
        (F.replace("alignment.aligned_query", F.lit("-"), F.lit("")) == F.substring(F.col("sequence"), F.col("alignment.q_start") + 1, F.col("alignment.q_end") - F.col("alignment.q_start"))).alias("letters"),
        (cigar.to_text(cigar.from_aligned("alignment.aligned_query", "alignment.aligned_subject")) == F.col("alignment.cigar")).alias("ops"),
    )


def sw_end_positions(spark, d):
    out = align_to_references(_named(spark, d), reference(spark, d), trace=False)
    return out.select("doc_id", "alignment.score", "alignment.q_end", "alignment.s_end")


def nw_alignment_invariants(spark, d):
    """Per document, whether a global alignment covers both sequences, and its ops, worth their scores, add up to the score."""
    a = align_to_references(_named(spark, d), reference(spark, d), local=False).withColumn("o", cigar.parse("alignment.cigar"))
    gaps = cigar.consumed("o", "ID")
    pairs = F.zip_with(F.split("alignment.aligned_query", ""), F.split("alignment.aligned_subject", ""), lambda x, y: F.struct(x.alias("aa1"), y.alias("aa2")))
    cells = a.select("doc_id", F.explode(F.filter(pairs, lambda p: (p["aa1"] != "-") & (p["aa2"] != "-") & (p["aa1"] != ""))).alias("p")).select("doc_id", "p.*")
    worth = cells.join(F.broadcast(blosum62().frame(spark)), ["aa1", "aa2"]).groupBy("doc_id").agg(F.sum("score").alias("worth"))
    return a.join(worth, "doc_id", "left").select(
        "doc_id",
        (cigar.query_length("o") == F.length("sequence")).alias("whole_query"),
        (cigar.reference_length("o") == F.length("ref_sequence")).alias("whole_subject"),
        (F.coalesce("worth", F.lit(0)) - gaps == F.col("alignment.score")).alias("adds_up"),
    )


def best_hit_per_query(spark, d):
    refs = references(spark, d).drop("key")
    return best_hits(align_to_references(_named(spark, d), refs, trace=False), "doc_id").select("doc_id", "ref_name", "alignment.score")


def sw_filtered(spark, d):
    """Filters after the alignment: by score, then by identity."""
    a = align_to_references(_named(spark, d), reference(spark, d))
    return filter_by_identity(filter_by_score(a, LEAST), 60.0).select("doc_id", "alignment.score", "alignment.cigar")


def _rows(spark, d):
    """Two gapped rows from each document: A as a gap on one side, E on the other."""
    return seqs(spark, d).select("doc_id", F.replace("seq", F.lit("A"), F.lit("-")).alias("a"), F.replace(F.replace("seq", F.lit("E"), F.lit("-")), F.lit("R"), F.lit("K")).alias("b"))


ROWS = f"{LETTERS}, pl AS (SELECT doc_id, i, CASE aa WHEN 'A' THEN '-' ELSE aa END AS a, CASE aa WHEN 'E' THEN '-' WHEN 'R' THEN 'K' ELSE aa END AS b FROM letters)"


def alignment_identity(spark, d):
    return _rows(spark, d).select("doc_id", F.round(cigar.identity("a", "b"), 6).alias("identity"), cigar.gap_count("a", "b").alias("gaps"))


def generated_cigar(spark, d):
    return _rows(spark, d).select("doc_id", cigar.to_text(cigar.from_aligned("a", "b", F.lit(2), F.col("doc_id") % 3)).alias("cigar"))


def _runs(letter: str, source: str) -> str:
    """RLE of `letter` over rows (doc_id, i) by islands."""
    return f"""SELECT doc_id, string_agg(n::VARCHAR || op, '' ORDER BY first) AS cigar FROM (SELECT doc_id, op, min(i) AS first, count(*) AS n FROM (
  SELECT doc_id, i, op, i - row_number() OVER (PARTITION BY doc_id, op ORDER BY i) AS g FROM (SELECT doc_id, i, {letter} AS op FROM {source})) GROUP BY doc_id, op, g) GROUP BY doc_id"""


_OP = "CASE WHEN a = '-' THEN 'D' WHEN b = '-' THEN 'I' WHEN a = b THEN '=' ELSE 'X' END"


def cigar_compress(spark, d):
    letters = F.translate("seq", "ARNDCEQGHILKMFPSTWYVBX", "MMMMMMIIIIIIIIDDDDDDDD")
    return seqs(spark, d).select("doc_id", cigar.to_text(cigar.compress(letters)).alias("cigar"))


def _tokens(spark, d):
    text = F.concat(*(F.concat((F.col(c) % k + 1).cast("long").cast("string"), F.lit(op)) for c, k, op in (("l_partkey", 9, "S"), ("l_orderkey", 40, "M"), ("l_suppkey", 7, "I"), ("l_linenumber", 5, "D"), ("l_quantity", 30, "="))))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("cigar"))


TOKENS = "c AS (SELECT l_orderkey, l_linenumber, l_partkey % 9 + 1 AS s, l_orderkey % 40 + 1 AS m, l_suppkey % 7 + 1 AS i, l_linenumber % 5 + 1 AS d, (l_quantity % 30 + 1)::BIGINT AS e FROM lineitem)"


def cigar_lengths(spark, d):
    ops = _tokens(spark, d).withColumn("ops", cigar.parse("cigar"))
    return ops.select("l_orderkey", "l_linenumber", "cigar", cigar.query_length("ops").alias("query"), cigar.query_length("ops", clips=True).alias("clipped"), cigar.reference_length("ops").alias("reference"), cigar.query_position("ops", F.lit(40)).alias("at_query"), cigar.reference_position("ops", F.lit(40)).alias("at_reference"))


def cigar_from_hmm_path(spark, d):
    states = F.transform(F.filter(F.split("seq", ""), lambda c: c != ""), lambda c: (F.instr(F.lit("ARNDCEQGHILKMFPSTWYVBX"), c) % 4).cast("int"))
    return seqs(spark, d).select("doc_id", cigar.to_text(cigar.from_hmm_path(states)).alias("cigar"))


def kernel_strategy(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 3000).alias("m"), (F.col("o_orderkey") % 3000).alias("n"), (F.col("o_totalprice") % 1).alias("like"))
    memory = device_memory("m", "n")
    return o.select("o_orderkey", strategy("m", "n").alias("cpu"), strategy("m", "n", True, F.when(F.col("o_orderkey") % 2 == 0, F.col("like"))).alias("device"), memory.alias("bytes"), (memory < (16 << 20) / 2).alias("fits"))


QUERIES = {
    "sw_top_hits": sw_top_hits,
    "sw_score_vs_reference": _scores(),
    "nw_score_vs_reference": _scores(False),
    "nw_open_edge_score": _scores(False, edge="open"),
    "sw_banded_score": _scores(True, band=BAND),
    "nw_banded_score": _scores(False, band=BAND),
    "sw_simple_score": _scores(matrix=simple(), penalty=GapPenalty(-2, -2)),
    "nw_simple_score": _scores(False, matrix=simple(), penalty=GapPenalty(-2, -2)),
    "sw_alignments": sw_alignments,
    "nw_alignments": nw_alignments,
    "sw_alignment_invariants": sw_alignment_invariants,
    "sw_end_positions": sw_end_positions,
    "nw_alignment_invariants": nw_alignment_invariants,
    "best_hit_per_query": best_hit_per_query,
    "sw_filtered": sw_filtered,
    "alignment_identity": alignment_identity,
    "generated_cigar": generated_cigar,
    "cigar_compress": cigar_compress,
    "cigar_lengths": cigar_lengths,
    "cigar_from_hmm_path": cigar_from_hmm_path,
    "kernel_strategy": kernel_strategy,
}
_banded_nw = dp_sql(False, -11, BAND)
SQL = {
    "sw_top_hits": f"SELECT * FROM ({dp_sql(True)}) WHERE score >= {LEAST}",
    "sw_score_vs_reference": dp_sql(True),
    "nw_score_vs_reference": dp_sql(False, -1),
    "nw_open_edge_score": dp_sql(False, -11),
    "sw_banded_score": dp_sql(True, -1, BAND),
    "nw_banded_score": f"SELECT doc_id, CASE WHEN score > {NONE // 2} THEN score END AS score FROM ({_banded_nw})",
    "sw_simple_score": dp_sql(True, gap=-2, simple=(2, -1)),
    "nw_simple_score": dp_sql(False, -2, gap=-2, simple=(2, -1)),
    "sw_alignment_invariants": f"WITH {SEQS} SELECT doc_id, true AS query_spans, true AS subject_spans, true AS clips, true AS letters, true AS ops FROM seqs",
    "sw_end_positions": ends_sql(),
    "nw_alignment_invariants": f"WITH {SEQS} SELECT doc_id, true AS whole_query, true AS whole_subject, true AS adds_up FROM seqs",
    "best_hit_per_query": f"{dp_rows(True, of='')}, b AS (SELECT doc_id, ref_name, max(h)::INT AS score FROM r GROUP BY ALL) SELECT doc_id, ref_name, score FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ref_name) = 1",
    "alignment_identity": f"WITH {ROWS} SELECT doc_id, coalesce(round(100.0 * sum((a = b AND a <> '-')::INT) / nullif(sum((a <> '-')::INT), 0), 6), 0) AS identity, sum((a = '-' OR b = '-')::INT)::INT AS gaps FROM pl GROUP BY doc_id",
    "generated_cigar": f"WITH {ROWS}, body AS ({_runs(_OP, 'pl')}) SELECT doc_id, '2S' || cigar || CASE WHEN doc_id % 3 > 0 THEN (doc_id % 3)::VARCHAR || 'S' ELSE '' END AS cigar FROM body",
    "cigar_compress": f"WITH {LETTERS} {_runs("translate(aa, 'ARNDCEQGHILKMFPSTWYVBX', 'MMMMMMIIIIIIIIDDDDDDDD')", 'letters')}",
    "cigar_lengths": f"WITH {TOKENS} SELECT l_orderkey, l_linenumber, s || 'S' || m || 'M' || i || 'I' || d || 'D' || e || '=' AS cigar, (m + i + e)::INT AS query, (s + m + i + e)::INT AS clipped, (m + d + e)::INT AS reference, CASE WHEN s + m + i + e >= 40 THEN 40 END AS at_query, CASE WHEN m + d + e >= 40 THEN 40 END AS at_reference FROM c",
    "cigar_from_hmm_path": f"WITH {LETTERS} {_runs("substr('=IDM', (instr('ARNDCEQGHILKMFPSTWYVBX', aa) % 4 + 1)::INT, 1)", 'letters')}",
    "kernel_strategy": """WITH o AS (SELECT o_orderkey, o_custkey % 3000 AS m, o_orderkey % 3000 AS n, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice % 1 END AS alike FROM orders), c AS (SELECT *, m * n AS cells, 4 * (m + 1) * (n + 1) + m + n + 2304 + 1048576 AS bytes FROM o)
SELECT o_orderkey, CASE WHEN cells < 1048576 THEN 'Simd' ELSE 'Banded' END AS cpu, CASE WHEN cells <= 1024 THEN 'Scalar' WHEN cells > 1048576 THEN 'GpuTiled' WHEN alike > 0.7 THEN 'Banded' ELSE 'GpuFull' END AS device, bytes, bytes < 8388608 AS fits FROM c""",
}

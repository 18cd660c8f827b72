"""Queries of columns, profiles, distances and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import evolution as ev
from strandloom.operators import hmm, trees
from strandloom.operators import profile as pr
from strandloom.operators.matrices import FREQUENCIES
from strandloom.plans.views import COLS, FAMILIES, LETTERS, SEQS, families, msa, read, seqs


def _r(df, *cols):
    return df.select(*(F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns))


PAIRS = f"""{FAMILIES}, l AS (SELECT msa_id, seq_idx, string_split(sequence, '') AS l FROM fam), pr AS (SELECT a.msa_id, a.seq_idx AS i, b.seq_idx AS j, a.l AS a, b.l AS b, greatest(len(a.l), len(b.l)) AS n FROM l a JOIN l b ON a.msa_id = b.msa_id AND a.seq_idx < b.seq_idx),
df AS (SELECT msa_id, i, j, n, list_sum(list_transform(range(1, n + 1), lambda x: (coalesce(a[x], '-') <> coalesce(b[x], '-'))::INT)) AS differ, list_sum(list_transform(range(1, least(len(a), len(b)) + 1), lambda x: (a[x] <> b[x] AND a[x] <> '-' AND b[x] <> '-')::INT)) AS changed FROM pr)"""
#: Queries of a search: rows whose id is divisible by 50, against all rows of their family.
SEARCHES = PAIRS.replace("a.seq_idx < b.seq_idx", "a.seq_idx % 50 = 0 AND a.seq_idx <> b.seq_idx")
_FREQ = "bg AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in FREQUENCIES.items()) + ") t(aa, b))"
_HEN = """ng AS (SELECT * FROM cnt WHERE aa NOT IN ('-', '.')), kinds AS (SELECT msa_id, pos, count(*) AS k FROM ng GROUP BY 1, 2), raw AS (SELECT cols.msa_id, seq_idx, sum(1.0 / (k * c)) AS w FROM cols JOIN ng USING (msa_id, pos, aa) JOIN kinds USING (msa_id, pos) GROUP BY 1, 2),
wt AS (SELECT msa.msa_id, msa.seq_idx, coalesce(w * n / sum(w) OVER (PARTITION BY msa.msa_id), 1.0) AS weight FROM msa LEFT JOIN raw USING (msa_id, seq_idx) JOIN sz ON sz.msa_id = msa.msa_id)"""
_PSSM = f"""{_HEN}, grid AS (SELECT msa_id, unnest(range(0, width))::INT AS pos FROM sz), g20 AS (SELECT msa_id, pos, unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) AS aa FROM grid),
wc AS (SELECT msa_id, pos, aa, coalesce(f, 0) AS f FROM g20 LEFT JOIN (SELECT msa_id, pos, aa, sum(weight) AS f FROM cols JOIN wt USING (msa_id, seq_idx) GROUP BY 1, 2, 3) USING (msa_id, pos, aa)),
ps AS (SELECT msa_id, pos, aa, f, log2((CASE WHEN sum(f) OVER w > 0 THEN f / sum(f) OVER w ELSE 0.05 END + 0.05) / 2 / 0.05) AS pssm FROM wc WINDOW w AS (PARTITION BY msa_id, pos))"""
_WIDE = "ww AS (SELECT msa_id, pos, aa, count(*) * 1.0 AS w FROM cols GROUP BY 1, 2, 3), wp AS (SELECT msa_id, pos, aa, (w + 1) / (sum(w) OVER (PARTITION BY msa_id, pos) + 24) AS p FROM ww)"


def _asked():
    return F.col("seq_idx") % 50 == 0


def _even(spark, d):
    return msa(spark, d).select("msa_id", "seq_idx", F.lit(1.0).alias("weight"))


def _similarity(spark, d):
    """Every pair of two sources' profiles, the smaller name first."""
    return _r(pr.profile_similarities(pr.pipeline_pssm(msa(spark, d))), "similarity")


def _nodes(spark, d):
    """A tree of orders: each customer's orders hang below the smallest."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("tree_id"), F.col("o_orderkey").alias("node_id"), (F.col("o_orderkey") % 1000).cast("double").alias("branch_length"))
    root = o.groupBy("tree_id").agg(F.min("node_id").alias("root"), F.collect_list("node_id").alias("all"))
    parent = F.when(F.col("node_id") != F.col("root"), F.col("root"))
    kids = F.when(F.col("node_id") == F.col("root"), F.filter("all", lambda x: x != F.col("root"))).otherwise(F.array().cast("array<bigint>"))
    return o.join(root, "tree_id").select("tree_id", "node_id", parent.alias("parent"), "branch_length", kids.alias("children"))


NODES = "o AS (SELECT o_custkey AS tree_id, o_orderkey AS node_id, (o_orderkey % 1000)::DOUBLE AS bl FROM orders), nd AS (SELECT *, min(node_id) OVER (PARTITION BY tree_id) AS root, count(*) OVER (PARTITION BY tree_id) AS n FROM o)"


def hmm_scores(spark, d):
    """Every word against the model of its own alignment."""
    m = msa(spark, d)
    out = hmm.search_own(m, hmm.collect_models(hmm.emissions(m)))
    return hmm.domains(out).select("msa_id", "seq_idx", F.round("viterbi", 6).alias("viterbi"), "path", F.round("forward", 6).alias("forward"), F.size("domains").alias("n_domains"))


def path_domains(spark, d):
    path = F.translate(F.col("seq"), "ARNDCEQGHILKMFPSTWYVBX", "MMMMMMMMMMMMIIIIDDDDDD")
    rows = hmm.domains(seqs(spark, d).select("doc_id", path.alias("path")))
    return rows.select("doc_id", F.explode("domains").alias("x")).select("doc_id", "x.s", "x.e")


def _sets(spark, d):
    """What every two neighbours of every document can be together, and how many pairs there are of each kind."""
    letters = seqs(spark, d).select(F.filter(F.split("seq", ""), lambda c: c != "").alias("l"))
    pairs = letters.select(F.explode(F.zip_with(F.col("l"), F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p")).where("p.b is not null")
    kinds = pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).select(ev.state_set("a").alias("a"), ev.state_set("b").alias("b"), "n")
    states, changes = ev.fitch_union("a", "b")
    return kinds.select(F.array_join(states, "").alias("states"), changes.alias("changes"), "n").groupBy("states", "changes").agg(F.sum("n").alias("n"))


_SET = "CASE {0} WHEN 'B' THEN ['D', 'N'] WHEN 'Z' THEN ['E', 'Q'] WHEN 'X' THEN string_split('ACDEFGHIKLMNPQRSTVWY', '') ELSE [{0}] END"


def substitution_probabilities(spark, d):
    rows = read(spark, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("t"))
    p = lambda m, **k: F.round(ev.transition_probability("t", model=m, **k), 9)
    yes, no = F.lit(True), F.lit(False)
    return rows.select("p_partkey", p("JC", same=yes).alias("jc_same"), p("JC", same=no).alias("jc_other"), p("K2P", same=yes).alias("k2p_same"), p("K2P", same=no, transition=yes).alias("k2p_transition"), p("K2P", same=no, transition=no).alias("k2p_transversion"))


def sequence_likelihood(spark, d):
    nt = F.translate(F.col("seq"), "ARNDCEQGHILKMFPSTWYVBX", "ACGTACGTACGTACGTACGTNN")
    rows = seqs(spark, d).select("doc_id", nt.alias("a"), F.reverse(nt).alias("b"))
    return rows.select("doc_id", F.round(ev.sequence_log_likelihood("a", "b", F.lit(0.3)), 6).alias("score"))


QUERIES = {
    "jukes_cantor_distances": lambda s, d: ev.jukes_cantor_searches(families(s, d), _asked()).select("msa_id", "i", "j", (F.round("distance", 6) + 0.0).alias("distance")),
    "dirichlet_pssm": lambda s, d: pr.wide_pssm(msa(s, d), _even(s, d)).select("msa_id", "pos", "aa", F.round(pr.dirichlet("pssm", 0.2), 6).alias("score")),
    "msa_consensus": lambda s, d: pr.consensus(msa(s, d), 0.1),
    "msa_conservation": lambda s, d: _r(pr.conservation(msa(s, d)), "conservation"),
    "msa_frequencies": lambda s, d: _r(pr.frequencies(msa(s, d)), "freq"),
    "henikoff_weights": lambda s, d: _r(pr.henikoff_weights(msa(s, d)), "weight"),
    "pipeline_pssm": lambda s, d: _r(pr.pipeline_pssm(msa(s, d)), "f", "pssm"),
    "natural_pssm": lambda s, d: _r(pr.natural_pssm(msa(s, d)), "score"),
    "gap_penalties": lambda s, d: pr.gap_penalties(msa(s, d)).select("msa_id", "pos", (F.round("gap_open", 6) + 0.0).alias("gap_open"), "gap_extend"),
    "wide_pssm": lambda s, d: _r(pr.wide_pssm(msa(s, d), _even(s, d)), "p", "pssm"),
    "column_divergence": lambda s, d: _r(pr.divergence(pr.wide_pssm(msa(s, d), _even(s, d))), "entropy", "kl"),
    "profile_scores": lambda s, d: _r(pr.score_profile(msa(s, d), pr.pipeline_pssm(msa(s, d))), "score"),
    "score_frequency": lambda s, d: pr.score_frequency(pr.pipeline_pssm(msa(s, d)), 0.5),
    "profile_consensus": lambda s, d: pr.profile_consensus(pr.weighted_counts(msa(s, d), _even(s, d)), "f"),
    "gapped_columns": lambda s, d: pr.gapped_columns(msa(s, d), 0.02),
    "profile_similarity": _similarity,
    "msa_distances": lambda s, d: _r(pr.distance_searches(families(s, d), _asked()), "distance"),
    "msa_coverage": lambda s, d: _r(pr.coverage(seqs(s, d).select(F.col("lang").alias("msa_id"), F.col("doc_id").alias("seq_idx"), F.col("seq").alias("sequence"))), "coverage"),
    "parsimony_score": lambda s, d: ev.parsimony_score(msa(s, d)),
    "pair_log_score": lambda s, d: _r(ev.pair_log_score(families(s, d)), "score"),
    "fitch_states": _sets,
    "substitution_probabilities": substitution_probabilities,
    "sequence_likelihood": sequence_likelihood,
    "tree_statistics": lambda s, d: _r(ev.tree_statistics(_nodes(s, d)), "mean_branch", "longest_pair"),
    "swap_candidates": lambda s, d: ev.swap_candidates(_nodes(s, d)),
    "hmm_emissions": lambda s, d: _r(hmm.emissions(msa(s, d)), "emission"),
    "hmm_states": lambda s, d: hmm.states(msa(s, d)),
    "hmm_scores": hmm_scores,
    "path_domains": path_domains,
    "upgma_trees": lambda s, d: trees.tree_texts(families(s, d), "upgma"),
    "neighbour_joining_trees": lambda s, d: trees.tree_texts(families(s, d), "nj"),
    "tree_nodes": lambda s, d: trees.build_trees(families(s, d), "upgma"),
}
SQL = {
    "score_frequency": f"WITH {COLS}, {_PSSM} SELECT msa_id, pos, sum((pssm >= 0.5)::INT)::BIGINT AS n FROM ps GROUP BY 1, 2",
    "profile_consensus": f"WITH {COLS}, g AS (SELECT msa_id, unnest(range(0, width))::INT AS pos FROM sz), g20 AS (SELECT msa_id, pos, unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) AS aa FROM g), b AS (SELECT msa_id, pos, aa, row_number() OVER (PARTITION BY msa_id, pos ORDER BY coalesce(c, 0) DESC, aa) AS r FROM g20 LEFT JOIN cnt USING (msa_id, pos, aa)) SELECT msa_id, string_agg(aa, '' ORDER BY pos) AS consensus FROM b WHERE r = 1 GROUP BY 1",
    "jukes_cantor_distances": f"WITH {SEARCHES} SELECT msa_id, i, j, round(-0.75 * ln(greatest(1 - 4 * changed / n / 3, 0.001)), 6) + 0.0 AS distance FROM df",
    "dirichlet_pssm": f"WITH {COLS}, {_WIDE} SELECT msa_id, pos, aa, round(ln(greatest(p * 24, 0.001)) * 0.8 + ln(1 / 24.0) * 0.2, 6) AS score FROM wp",
    "msa_consensus": f"WITH {COLS}, b AS (SELECT msa_id, pos, aa, c, row_number() OVER (PARTITION BY msa_id, pos ORDER BY c DESC, aa) AS r FROM cnt) SELECT b.msa_id, string_agg(CASE WHEN c * 1.0 / n >= 0.1 THEN aa ELSE 'X' END, '' ORDER BY pos) AS consensus FROM b JOIN sz USING (msa_id) WHERE r = 1 GROUP BY 1",
    "msa_conservation": f"WITH {COLS}, t AS (SELECT *, sum(c) OVER (PARTITION BY msa_id, pos) AS t FROM cnt) SELECT msa_id, pos, round(1 - least(greatest(-sum(c / t * log2(c / t)) / log2(20), 0), 1), 6) AS conservation FROM t GROUP BY 1, 2",
    "msa_frequencies": f"WITH {COLS} SELECT msa_id, pos, aa, round(c * 1.0 / n, 6) AS freq FROM cnt JOIN sz USING (msa_id)",
    "henikoff_weights": f"WITH {COLS}, {_HEN} SELECT msa_id, seq_idx, round(weight, 6) AS weight FROM wt",
    "pipeline_pssm": f"WITH {COLS}, {_PSSM} SELECT msa_id, pos, aa, round(f, 6) AS f, round(pssm, 6) AS pssm FROM ps",
    "natural_pssm": f"WITH {COLS}, {_FREQ} SELECT msa_id, pos, aa, round(ln((c + 0.5) / n / b), 6) AS score FROM cnt JOIN sz USING (msa_id) JOIN bg USING (aa)",
    "gap_penalties": f"WITH {COLS}, t AS (SELECT *, sum(c) OVER (PARTITION BY msa_id, pos) AS t FROM cnt), v AS (SELECT msa_id, pos, 1 - least(greatest(-sum(c / t * log2(c / t)) / log2(20), 0), 1) AS x FROM t GROUP BY 1, 2) SELECT msa_id, pos, round(-11.0 * (1 - x * x), 6) + 0.0 AS gap_open, -1.0::DOUBLE AS gap_extend FROM v",
    "wide_pssm": f"WITH {COLS}, {_WIDE} SELECT msa_id, pos, aa, round(p, 6) AS p, round(ln(greatest(p * 24, 0.001)), 6) AS pssm FROM wp",
    "column_divergence": f"WITH {COLS}, {_WIDE} SELECT msa_id, pos, round(sum(-p * ln(p)), 6) AS entropy, round(sum(p * ln(p * 24)), 6) AS kl FROM wp GROUP BY 1, 2",
    "profile_scores": f"WITH {COLS}, {_PSSM} SELECT msa_id, seq_idx, round(coalesce(sum(pssm), 0), 6) AS score FROM cols LEFT JOIN ps USING (msa_id, pos, aa) GROUP BY 1, 2",
    "gapped_columns": f"WITH {COLS} SELECT msa_id, pos, avg((aa IN ('-', '.'))::INT) > 0.02 AS gapped FROM cols GROUP BY 1, 2",
    "profile_similarity": f"WITH {COLS}, {_PSSM} SELECT a.msa_id AS a_id, b.msa_id AS b_id, a.pos AS a_pos, b.pos AS b_pos, round(sum(a.pssm * b.pssm), 6) AS similarity FROM ps a JOIN ps b USING (aa) WHERE a.msa_id < b.msa_id GROUP BY 1, 2, 3, 4",
    "msa_distances": f"WITH {SEARCHES} SELECT msa_id, i, j, round(differ / n, 6) AS distance FROM df",
    "msa_coverage": f"WITH {SEQS}, m AS (SELECT lang AS msa_id, doc_id, seq FROM seqs), s AS (SELECT msa_id, count(*) AS n, arg_min(length(seq), doc_id) AS w FROM m GROUP BY 1), c AS (SELECT msa_id, unnest(range(0, length(seq)))::INT AS pos FROM m) SELECT msa_id, pos, round(count(*) * 1.0 / any_value(n), 6) AS coverage FROM c JOIN s USING (msa_id) WHERE pos < w GROUP BY 1, 2",
    "parsimony_score": f"WITH {COLS} SELECT msa_id, sum(k - 1)::BIGINT AS score FROM (SELECT msa_id, pos, count(*) AS k FROM cnt GROUP BY 1, 2) GROUP BY 1",
    "pair_log_score": f"WITH {PAIRS}, x AS (SELECT msa_id, changed / n AS p FROM df), y AS (SELECT msa_id, p, -0.75 * ln(greatest(1 - 4 * p / 3, 0.001)) AS d FROM x) SELECT msa_id, round(coalesce(sum(ln(1 - d)) FILTER (WHERE p < 0.75 AND d < 1), 0), 6) AS score FROM y GROUP BY 1",
    "fitch_states": f"WITH {LETTERS}, p AS (SELECT aa AS x, lead(aa) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM letters), k AS (SELECT x, y, count(*) AS n FROM p WHERE y IS NOT NULL GROUP BY 1, 2), s AS (SELECT {_SET.format('x')} AS a, {_SET.format('y')} AS b, n FROM k), t AS (SELECT n, list_sort(list_intersect(a, b)) AS x, list_sort(list_distinct(list_concat(a, b))) AS u FROM s) SELECT array_to_string(CASE WHEN len(x) > 0 THEN x ELSE u END, '') AS states, CASE WHEN len(x) > 0 THEN 0 ELSE 1 END AS changes, sum(n)::BIGINT AS n FROM t GROUP BY 1, 2",
    "substitution_probabilities": "WITH r AS (SELECT p_partkey, p_size / 50.0 AS t FROM part), e AS (SELECT p_partkey, exp(-4 * t / 3) AS e, exp(-t) AS e1, exp(-2 * 0.75 * t) AS e2 FROM r) SELECT p_partkey, round(0.25 + 0.75 * e, 9) AS jc_same, round(0.25 - 0.25 * e, 9) AS jc_other, round(0.25 + 0.25 * e1 + 0.5 * e2, 9) AS k2p_same, round(0.25 + 0.25 * e1 - 0.5 * e2, 9) AS k2p_transition, round(0.25 - 0.25 * e1, 9) AS k2p_transversion FROM e",
    "sequence_likelihood": f"WITH {LETTERS}, n AS (SELECT doc_id, i, translate(aa, 'ARNDCEQGHILKMFPSTWYVBX', 'ACGTACGTACGTACGTACGTNN') AS x, count(*) OVER (PARTITION BY doc_id) AS m FROM letters), p AS (SELECT a.doc_id, a.x, b.x AS y FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.i = a.m + 1 - a.i) SELECT doc_id, round(coalesce(sum(CASE WHEN x = y THEN ln(0.25 + 0.75 * exp(-0.4)) ELSE ln(0.25 - 0.25 * exp(-0.4)) END) FILTER (WHERE x <> 'N' AND y <> 'N'), 0), 6) AS score FROM p GROUP BY 1",
    "tree_statistics": f"WITH {NODES} SELECT tree_id, sum((node_id <> root OR n = 1)::INT)::BIGINT AS taxa, sum((node_id = root AND n > 1)::INT)::BIGINT AS internals, round(avg(bl), 6) AS mean_branch, round(2 * max(bl), 6) AS longest_pair FROM nd GROUP BY 1",
    "swap_candidates": f"WITH {NODES} SELECT a.tree_id, a.node_id AS i, b.node_id AS j FROM nd a JOIN nd b ON a.tree_id = b.tree_id AND a.node_id < b.node_id WHERE a.node_id <> a.root",
    "hmm_emissions": f"WITH {COLS} SELECT msa_id, pos, aa, round(ln(greatest(c * 1.0 / n, 0.001)), 6) AS emission FROM cnt JOIN sz USING (msa_id)",
    "hmm_states": f"WITH {COLS} SELECT msa_id, width AS length, 3 * width + 2 AS n_states FROM sz",
    "path_domains": f"WITH {LETTERS}, m AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM letters WHERE translate(aa, 'ARNDCEQGHILKMFPSTWYVBX', 'MMMMMMMMMMMMIIIIDDDDDD') = 'M') SELECT doc_id, (min(i) - 1)::INT AS s, max(i)::INT AS e FROM m GROUP BY doc_id, g",
}

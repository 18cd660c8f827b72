"""Fixed values and invariants of the sequence operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import cigar, residues, statistics
from strandloom.functions.residues import ALPHABET
from strandloom.operators import align as al
from strandloom.operators import evolution, hmm, profile, trees
from strandloom.operators.dp import Scheme, align
from strandloom.operators.matrices import GapPenalty, blosum62, parse_matrix, validate

SCORES = blosum62().lookup()
ROWS = ["MVLSPAD", "MVLSPAD", "MPLSPAD", "MVLSKAD"]


def slow(q, s, local, edge="extend", band=None):
    """Cell by cell, as the recurrence stands."""
    m, n, none = len(q), len(s), -(1 << 30)
    banded = band is not None and 0.5 <= m / n <= 2
    border = -11 if edge == "open" or band is not None else -1
    h = [[0 if local else none] * (n + 1) for _ in range(m + 1)]
    if not local:
        for j in range(n + 1):
            if not banded or j <= band:
                h[0][j] = j * border
        for i in range(m + 1):
            if not banded or i <= band:
                h[i][0] = i * border
    best = 0
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            if banded and abs(i - j) > band:
                continue
            v = max(h[i - 1][j - 1] + SCORES[ALPHABET.index(q[i - 1])][ALPHABET.index(s[j - 1])], h[i - 1][j] - 1, h[i][j - 1] - 1)
            h[i][j] = max(0, v) if local else v
            best = max(best, h[i][j])
    return best if local else h[m][n]


@pytest.mark.parametrize(
    "kind, q, s, score, spans, clips, text",
    [
        ("SW", "AGSGD", "AGSGDSAF", 26, (0, 5, 0, 5), (0, 0), "5="),
        ("SW", "DSAF", "AGSGDSAF", 20, (0, 4, 4, 8), (0, 0), "4="),
        ("SW", "GGGGGGGG", "AGSGDSAF", 12, (0, 3, 1, 4), (0, 5), "1=1X1="),
        ("SW", "SSSACDEFGH", "ACDEFGHTTT", 44, (3, 10, 0, 7), (3, 0), "7="),
        ("SW", "XXXACDEFGXXX", "ACDEFG", 36, (3, 9, 0, 6), (3, 3), "6="),
        ("SW", "MVHLTPEEKS", "MGHLTPEEKS", 46, (0, 10, 0, 10), (0, 0), "1=1D1I8="),
        ("SW", "AS", "SA", 4, (1, 2, 0, 1), (1, 0), "1="),
        ("NW", "MGLS", "MGLSD", 18, (0, 4, 0, 5), (0, 0), "4=1D"),
        ("NW", "AGSGDSAF", "AGSGD", 23, (0, 8, 0, 5), (0, 0), "5=3I"),
    ],
)
def test_alignments(kind, q, s, score, spans, clips, text):
    r = align([q], [s], Scheme(SCORES), kind == "SW")
    assert r["score"] == [score] and r["cigar"] == [text]
    assert tuple(r[c][0] for c in ("q_start", "q_end", "s_start", "s_end")) == spans
    assert (r["clip_left"][0], r["clip_right"][0]) == clips


def test_scores_equal_the_recurrence():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("ARNDCEQGHILKX", k=rng.randint(1, 14)))
    for _ in range(150):
        q, s = word(), word()
        for local in (True, False):
            for edge, band in (("extend", None), ("open", None), ("open", 3)):
                got = align([q, s], [s, q], Scheme(SCORES, edge=edge, band=band), local, trace=False)["score"][0]
                want = slow(q, s, local, edge, band)
                assert got == (want if want > -(10**8) else None)


def test_row_ties_and_unreachable_corners():
    assert align(["AS"], ["SA"], Scheme(SCORES, tie="row"))["clip_right"] == [1]
    assert align(["AGSGDSAF"], ["AGSGD"], Scheme(SCORES, band=2), False)["score"] == [None]
    assert align(["", "A"], ["A", ""], Scheme(SCORES))["score"] == [None, None]


def test_align_frames(spark):
    q = spark.createDataFrame([("a", "AGSGDSAF"), ("b", "GGGGGGGG"), ("c", None), ("d", "")], "name string, sequence string")
    r = spark.createDataFrame([("r", "AGSGDSAF")], "ref_name string, ref_sequence string")
    got = {x["name"]: x["alignment"] for x in al.align_to_references(q, r).collect()}
    assert got["a"]["score"] == 40 and got["b"]["score"] == 12 and got["c"]["score"] is None and got["d"]["score"] is None
    assert [x["name"] for x in al.align_to_references(q, r, least_score=20).collect()] == ["a"]
    with pytest.raises(Exception, match="EmptySequence"):
        al.align_pairs(q.withColumn("s", F.lit("A")), "sequence", "s", on_error="raise").collect()


def test_matrices(spark):
    m = blosum62()
    assert m.score(0, 0) == 4 and m.score(24, 0) == -100 and (m.rows == m.rows.T).all()
    head = "ARNDCQEGHILKMFPSTWYVBZX*"
    text = "# a comment\n  " + " ".join(head) + "\n" + "\n".join(f"{c} " + " ".join(map(str, row)) for c, row in zip(head, m.rows))
    assert (parse_matrix("again", text).rows == m.rows).all()
    with pytest.raises(ValueError):
        parse_matrix("short", "A R\nA 1 2\nR 2 1")
    assert validate(m.frame(spark)).first().asDict() == {"matrix": "BLOSUM62", "cells": 576, "symmetric": True, "low": -4, "high": 11, "scaled": True}
    assert (GapPenalty().open, GapPenalty.strict().open, GapPenalty.liberal().open) == (-11, -16, -8)
    with pytest.raises(ValueError):
        GapPenalty(1, -1)


def test_cigar(spark):
    df = spark.createDataFrame([("5=2I3D1M",), ("10M2I5D",), ("M5",), ("",)], "c string").withColumn("o", cigar.parse("c"))
    rows = df.select("c", cigar.query_length("o").alias("q"), cigar.reference_length("o").alias("r"), cigar.to_text("o").alias("t")).collect()
    assert [(x["q"], x["r"], x["t"]) for x in rows] == [(8, 9, "5=2I3D1M"), (12, 15, "10M2I5D"), (None, None, None), (0, 0, "")]
    merged = spark.createDataFrame([([(2, "M"), (1, "I"), (0, "D"), (3, "M"), (2, "M")],)], "o array<struct<n:int,op:string>>")
    assert merged.select(cigar.to_text(cigar.coalesce_ops("o"))).first()[0] == "2M1I5M"
    path = spark.createDataFrame([([0, 0, 0, 1, 1, 0, 0, 2],)], "p array<int>")
    assert path.select(cigar.to_text(cigar.from_hmm_path("p"))).first()[0] == "3=2I2=1D"
    pairs = spark.createDataFrame([("AGSG", "AGSG"), ("AGSG", "AASG"), ("AG-SG", "AGASG"), ("", "")], "a string, b string")
    assert [tuple(x) for x in pairs.select(cigar.identity("a", "b"), cigar.gap_count("a", "b")).collect()] == [(100.0, 0), (75.0, 0), (100.0, 1), (0.0, 0)]


def test_residues(spark):
    df = spark.createDataFrame([("ag sgd",), ("AZ",), (" ",), (None,)], "s string")
    assert [tuple(x) for x in df.select(residues.parse_sequence("s"), residues.parse_error("s")).collect()] == [("AGSGD", None), (None, "InvalidAminoAcid"), (None, "EmptySequence"), (None, "EmptySequence")]


def test_statistics(spark):
    x = spark.range(1).select(
        statistics.karlin_evalue(F.lit(10.0), 1e6), statistics.karlin_bits(F.lit(85.0)), statistics.pfam_evalue(F.lit(20.0), 1e6), statistics.pfam_bits(F.lit(50.0)), statistics.pfam_pvalue(F.lit(50.0)), statistics.passes(F.lit(1.0), F.lit(None).cast("double"))
    ).first()
    assert list(x)[:5] == pytest.approx([970.8027177401, 41.8381561858, 2.7825575904e-4, 17.8095681332, 1.2437060236e-7]) and x[5]


@pytest.fixture(scope="module")
def msa(spark):
    return spark.createDataFrame([("m", i, s) for i, s in enumerate(ROWS)], "msa_id string, seq_idx int, sequence string")


def test_profiles(spark, msa):
    assert profile.consensus(msa, 0.75).first()["consensus"] == "MVLSPAD"
    c = [r["conservation"] for r in profile.conservation(msa).orderBy("pos").collect()]
    assert c == pytest.approx([1, 0.812288, 1, 1, 0.812288, 1, 1], abs=1e-6)
    d = {(r["i"], r["j"]): r["distance"] for r in profile.distance_matrix(msa).collect()}
    assert d == pytest.approx({(0, 1): 0, (0, 2): 1 / 7, (0, 3): 1 / 7, (1, 2): 1 / 7, (1, 3): 1 / 7, (2, 3): 2 / 7})
    h = spark.createDataFrame([("h", 0, "AAA"), ("h", 1, "AAA"), ("h", 2, "CCC")], msa.schema)
    assert [r["weight"] for r in profile.henikoff_weights(h).orderBy("seq_idx").collect()] == pytest.approx([0.75, 0.75, 1.5])
    g = spark.createDataFrame([("g", i, "AC-T") for i in range(3)], msa.schema)
    assert [r["pos"] for r in profile.gapped_columns(g).where("gapped").collect()] == [2]
    assert evolution.parsimony_score(msa).first()["score"] == 2
    assert evolution.pair_log_score(msa).first()["score"] == pytest.approx(-1.1359775776)
    p = spark.range(1).select(evolution.transition_probability(F.lit(0.1), F.lit(True)), evolution.transition_probability(F.lit(0.5), F.lit(False))).first()
    assert list(p) == pytest.approx([0.9063799893, 0.1216457202])


def test_models(spark, msa):
    model = hmm.collect_model(hmm.emissions(msa), 7)
    assert hmm.states(msa).first()["n_states"] == 23
    score, path = hmm.viterbi(model, "MVLSPAD")
    assert path == "MMMMMMM" and hmm.forward(model, "MVLSPAD") >= score
    b = hmm.backward_rows(model, hmm.encode("MVLSPAD")[None, :])[0][0][0, 0]
    assert b == pytest.approx(hmm.forward(model, "MVLSPAD"))
    assert np.all(hmm.posteriors(model, "MVLSPAD").sum(1) <= 1 + 1e-9)
    _, seen = hmm.baum_welch(model, ROWS, rounds=4, pseudo=1e-9)
    assert seen[-1] >= seen[1] - 1e-6  # the first model's emissions don't sum to 1
    d = hmm.domains(spark.createDataFrame([("DMMIMD",)], "path string")).first()["domains"]
    assert [tuple(x) for x in d] == [(1, 3), (4, 5)]


def test_trees(spark, msa):
    names = [f"seq{i}" for i in range(4)]
    tree = trees.upgma(names, trees.distances(ROWS))
    assert trees.newick(tree).count("seq") == 4 and trees.newick(tree).endswith(";")
    d = np.array([[0, 5, 9, 9, 8], [5, 0, 10, 10, 9], [9, 10, 0, 8, 7], [9, 10, 8, 0, 3], [8, 9, 7, 3, 0]], dtype=float)
    nj = trees.neighbour_joining(list("abcde"), d)
    length = {n["name"]: n["branch_length"] for n in nj if n["name"]}
    assert length == pytest.approx({"a": 2, "b": 3, "c": 4, "d": 2, "e": 1})
    rows = dict(zip(names, ROWS))
    cost, seqs = trees.ancestors(tree, rows)
    assert cost == 2 and all(len(s) == 7 for s in seqs.values())
    assert trees.common_ancestor(tree, ["seq0", "seq1"]) != trees.common_ancestor(tree, names)
    again = trees.reroot(nj, "c")
    assert {n["name"] for n in again if n["name"]} == set("abcde") and sum(n["branch_length"] for n in again) == pytest.approx(sum(n["branch_length"] for n in nj))
    assert trees.interchange(tree, rows)[1] <= cost
    share = trees.bootstrap(names, ROWS, times=20)
    assert share == trees.bootstrap(names, ROWS, times=20) and all(0 <= v <= 1 for v in share.values())
    got = trees.tree_texts(msa, "nj").first()
    assert got["tree_id"] == "m" and got["parsimony"] == 2
    assert trees.newick([]) == ";"


def test_readers_and_writers(spark, tmp_path):
    from strandloom.sources import bam, models, text

    (tmp_path / "x.fasta").write_text(">seq1 This is a description\nACD\nEFG\n>seq2\nMM\n>seq3 z\nA\n")
    got = [tuple(r) for r in text.read_sequences(spark, str(tmp_path / "x.fasta")).collect()]
    assert got == [("seq1", "This is a description", "ACDEFG", None), ("seq2", None, "MM", None), ("seq3", "z", "A", None)]
    (tmp_path / "x.fastq").write_text("@r1 d\nACGT\n+\nIII@\n@r2\nAC\n-\nII\n")
    got = [tuple(r) for r in text.read_fastq(spark, str(tmp_path / "x.fastq")).collect()]
    assert got == [("r1", "d", "ACGT", "III@", None), ("r2", None, "AC", "II", "separator")]
    (tmp_path / "x.tsv").write_text("a\tMM\tdesc\nb\n")
    assert [(r["id"], r["error"]) for r in text.read_tsv(spark, str(tmp_path / "x.tsv")).collect()] == [("a", None), ("b", "too few fields")]
    (tmp_path / "x.hmm").write_text("HMMER3/f\nNAME  F1\nACC   PF00001.28\nLENG  345\nALPH  amino\nGA    30.0 30.0;\nTC    35 35;\nNC    20 20;\n//\nHMMER3/f\nNAME  F2\n//\n")
    got = {r["name"]: r for r in models.read_models(spark, str(tmp_path / "x.hmm")).collect()}
    assert (got["F1"]["accession"], got["F1"]["length"], got["F1"]["ga"], got["F1"]["tc"], got["F1"]["nc"]) == ("PF00001.28", 345, 30.0, 35.0, 20.0) and got["F2"]["ga"] is None
    data = bam.pack([("chr1", 1000)], [bam.pack_record("r1", 0, 0, 5, 60, "3M1I", "ACGT", "IIII"), bam.pack_record("r2", 4, -1, -1, 0, "", "ACG", None)], "@HD\tVN:1.6\n")
    (tmp_path / "x.bam").write_bytes(data)
    got = bam.read_bam(spark, f"file://{tmp_path}/x.bam").collect()
    assert [(r["name"], r["pos"], r["cigar"], r["sequence"], r["quality"]) for r in got] == [("r1", 5, "3M1I", "ACGT", "IIII"), ("r2", -1, "", "ACG", None)]
    assert text.sam_header([("chr1", 248956422)], sort_order="coordinate") == ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:chr1\tLN:248956422"]
    line = spark.range(1).select(text.scientific(F.lit(1e-30)), text.scientific(F.lit(250.0)), text.scientific(F.lit(0.0))).first()
    assert list(line) == ["1e-30", "2.5e2", "0e0"]
    assert math.isinf(spark.range(1).select(models.score_token(F.lit("*"))).first()[0])


def test_streams(spark, tmp_path):
    from strandloom.streaming import coverage

    spark.createDataFrame([("m", s) for s in ("ACD", "AC", "A")], "msa_id string, sequence string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("msa_id string, sequence string").parquet(f"{tmp_path}/in")
    q = coverage.column_counts(stream, 3).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r["pos"]: r["coverage"] for r in coverage.coverage_of_counts(spark.table("counts")).collect()}
    assert got == pytest.approx({0: 1.0, 1: 2 / 3, 2: 1 / 3})
    seen = []
    q = coverage.process_chunks(stream, lambda df, _: seen.append(df.count()), f"{tmp_path}/cp", least_length=2)
    assert q.awaitTermination(120) and sum(seen) == 2


def test_profile_alignment(spark):
    from strandloom.operators.profile_align import align_profiles, align_to_profile, gotoh

    columns = np.full((4, 24), -2.0)
    for k, c in enumerate("ACDE"):
        columns[k, ALPHABET.index(c)] = 5.0
    df = spark.createDataFrame([("ACDE",), ("ADE",), ("ACKDE",), ("",), (None,)], "sequence string")
    got = [(r["path"], r["path_score"], r["gapped"]) for r in align_to_profile(df, columns).collect()]
    assert got[:3] == [("MMMM", 20.0, "ACDE"), ("MDMM", 4.0, "A-DE"), ("MMIMM", 9.0, "ACKDE")] and got[3][0] == got[4][0] == "DDDD"
    assert align_profiles(np.eye(24)[:4] * 3, np.eye(24)[:4] * 3)[1] == "MMMM"
    assert gotoh(np.array([[-1.0, 4.0], [-1.0, -1.0]]), local=True) == (4.0, "M", 0, 1)


def test_likelihood():
    from strandloom.operators import likelihood as lk

    q = lk.rates("JC")
    p = lk.probabilities(q, 0.1)
    assert p[0, 0] == pytest.approx(0.25 + 0.75 * math.exp(-4 * 0.1 / 3)) and np.allclose(p.sum(1), 1)
    for model in ("K2P", "HKY", "GTR"):
        assert np.allclose(lk.rates(model).sum(1), 0)
    a, b = "ACGT" * 10, "ACGT" * 9 + "ACTT"
    d = 1 / 40
    t = lk.best_length(lambda x: lk.pair_log_likelihood(a, b, x, q))
    assert t == pytest.approx(-0.75 * math.log(1 - 4 * d / 3), abs=1e-3)
    rows = {"seq0": a, "seq1": b, "seq2": "ACGA" * 10}
    tree = trees.neighbour_joining(list(rows), trees.distances(list(rows.values())))
    assert lk.optimise_branches(tree, rows, q, rounds=1)[1] >= lk.tree_log_likelihood(tree, rows, q)


SAMPLES = [
    "HMMER3/f [3.3 | Nov 2019]\nNAME  PF00001\nACC   PF00001.28\nDESC  receptor family\nLENG  345\nALPH  amino\n",
    "# STOCKHOLM 1.0\n#=GF ID   PF00001\n#=GF AC   PF00001.28\n#=GF DE   receptor family\n#=GF LEN  345\n",
    "# hmmsearch :: search profile(s) against a sequence database\n\nQuery:       PF00001  [M=345]\nAccession:   PF00001.28\nDescription: receptor family\n",
    "ID   IPR000001\nAC   IPR000001\nDE   Receptor superfamily\n",
    "nothing",
]
BODY = """HMMER3/f
NAME  tiny
LENG  2
STATS LOCAL MSV -8.0 0.7
HMM          A        C
            m->m     m->i     m->d     i->m     i->i     d->m     d->d
  COMPO   1.0 2.0
          0.7 0.7
          0.1 2.0 3.0 0.5 0.9 0.0 *
      1   0.2 1.8      1 a - - -
          0.7 0.7
          0.1 2.0 3.0 0.5 0.9 1.0 1.0
      2   1.8 0.2      2 c - - -
          0.7 0.7
          0.1 2.0 * 0.5 0.9 0.0 *
//
"""


def test_model_files(spark, tmp_path):
    from strandloom.sources import models

    got = [r["m"] for r in spark.createDataFrame([(x,) for x in SAMPLES], "c string").select(models.any_model("c").alias("m")).collect()]
    assert [(m["name"], m["accession"], m["length"]) if m else None for m in got] == [("PF00001", "PF00001.28", 345)] * 3 + [("IPR000001", "IPR000001", None), None]
    (tmp_path / "m.hmm").write_text(BODY + BODY.replace("tiny", "other"))
    rows = {r["name"]: r for r in models.read_bodies(spark, str(tmp_path / "m.hmm")).collect()}
    tiny = rows["tiny"]
    assert set(rows) == {"tiny", "other"} and tiny["letters"] == "AC" and tiny["match"] == [[-0.2, -1.8], [-1.8, -0.2]]
    assert len(tiny["insert"]) == 3 and tiny["transitions"][0][6] == -math.inf and tiny["stats"] == {"LOCAL MSV": [-8.0, 0.7]}


def test_tasks(spark, msa, tmp_path):
    from strandloom import api

    q = spark.createDataFrame([("a", "AGSGD")], "id string, sequence string")
    s = spark.createDataFrame([("r", "AGSGDSAF")], "id string, sequence string")
    assert api.align(q, s).first()["score"] == 26
    assert api.as_sam(api.align(q, s)).first()[0].split("\t")[:6] == ["a", "0", "r", "1", "60", "5="]
    assert set(api.msa(msa)) == {"distances", "tree", "conservation", "consensus"}
    model = hmm.collect_model(hmm.emissions(msa), 7)
    assert api.hmm_search(msa, model, evalue=1e9).count() == 4
    (tmp_path / "v.fa").write_text(">x\nACD\n>y\nAZ\n")
    assert [tuple(r) for r in api.validate(spark, str(tmp_path / "v.fa")).collect()] == [("x", None), ("y", "InvalidAminoAcid")]


def test_numbered_rows(spark):
    from strandloom.operators.batches import contiguous, numbered

    rng = random.Random(3)
    values = rng.sample(range(10**6), 5000)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    assert {r["v"]: r["_n"] for r in numbered(df, "v").collect()} == {v: i for i, v in enumerate(sorted(values))}
    assert numbered(df.limit(0), "v").count() == 0
    odd = spark.createDataFrame([(None,), ("b",), ("a",)], "v string")
    assert sorted((r["_n"], r["v"]) for r in numbered(odd, "v").collect()) == [(0, None), (1, "a"), (2, "b")]
    assert sorted(contiguous(df, "v", 3).groupBy("batch").count().collect())[0]["count"] == 1667


def test_long_cigars(spark):
    text = "1=1X" * 60_000
    df = spark.createDataFrame([(text, "=" * 200_000 + "ID"), ("5M3", "x"), ("M5", "x"), ("", "x")], "c string, l string")
    got = [tuple(r) for r in df.select(F.size(cigar.parse("c")), F.size(cigar.parse("c", strict=False)), cigar.to_text(cigar.compress("l"))).collect()]
    assert got[0] == (120_000, 120_000, "200000=1I1D")
    assert [r["n"] for r in df.where("length(c) < 9").select(cigar.parse("c").alias("n")).collect()] == [None, None, []]


def test_interchange_and_planning(spark):
    from strandloom.operators import batches, interchange
    from strandloom.operators.matrices import GapPenalty
    from strandloom.sources import models, text

    records = spark.createDataFrame([("a", [0, 3, 2, 1, 4, 9], "DNA"), ("b", [1], "Protein")], "id string, codes array<int>, type string")
    assert [r["sequence"] for r in interchange.dna_sequence(records).collect()] == ["ATGCNN", ""]
    twice = interchange.flagged(interchange.flagged(records, F.lit("x")), F.when(F.col("id") == "a", "y"))
    assert [(r["clinical_flags"], r["clinically_significant"]) for r in twice.collect()] == [(["x", "y"], True), (["x"], True)]
    assert not interchange.flagged(records, F.lit(None).cast("string")).first()["clinically_significant"]
    row = interchange.matrix_record(spark, blosum62(), GapPenalty.strict())
    assert row.first()["gap_open"] == -16 and (interchange.record_matrix(row)["BLOSUM62"].rows == blosum62().rows).all()
    other = spark.createDataFrame([("odd", [[1]])], "name string, scores array<array<int>>")
    assert interchange.record_matrix(other)["odd"].name == "BLOSUM62"
    one = spark.range(1).select(batches.speedup(F.lit("GpuFull")), batches.speedup(F.lit("?")), batches.stream_chunk(0), batches.stream_chunk(1)).first()
    assert list(one) == [50.0, None, 100, 1048]
    body = spark.createDataFrame([([[0.5, -1.0]], [[-0.1] * 7])], "match array<array<double>>, transitions array<array<double>>")
    assert list(body.select(models.emission("match", 0, 1), models.emission("match", 3, 0), models.transition("transitions", 0, "dd")).first()) == [-1.0, 0.0, -0.1]
    whole = text.fasta_records(spark.createDataFrame([(">a b c\nAC\nGT",)], "value string"), whole_header=True).first()
    assert tuple(whole) == ("a b c", None, "ACGT")
    msa = spark.createDataFrame([("m", 0, "AW")], "msa_id string, seq_idx int, sequence string")
    table = spark.createDataFrame([("m", 0, "A", 2.0)], "msa_id string, pos int, aa string, pssm double")
    assert sorted(r["score"] for r in profile.column_score(msa, table, -4.0).collect()) == [-4.0, 2.0]

"""Queries without SQL, and the operators behind them, against slow versions of themselves."""

import itertools
import math
import os
import random

import numpy as np
import pytest

from strandloom.functions.residues import ALPHABET
from strandloom.operators import hmm, pairwise, trees
from strandloom.operators.matrices import PUBLISHED_ORDER, blosum62, log_odds, point_accepted
from strandloom.plans import registry, views

SMALL = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
SCORES = blosum62().lookup().tolist()


def slow_alignment(q, s, local):
    """The whole matrix, cell by cell, and the way back: diagonal before the query's residue before the subject's."""
    h = [[0 if local else -(i + j) for j in range(len(s) + 1)] for i in range(len(q) + 1)]
    for i, j in itertools.product(range(1, len(q) + 1), range(1, len(s) + 1)):
        h[i][j] = max(h[i - 1][j - 1] + SCORES[ALPHABET.index(q[i - 1])][ALPHABET.index(s[j - 1])], h[i - 1][j] - 1, h[i][j - 1] - 1, *([0] if local else []))
    i, j = len(q), len(s)
    if local:
        _, j, i = min((-h[i][j], j, i) for i in range(len(q) + 1) for j in range(len(s) + 1))
    end, ops = (i, j), []
    while (h[i][j] > 0 and i and j) if local else (i or j):
        if i and j and h[i][j] == h[i - 1][j - 1] + SCORES[ALPHABET.index(q[i - 1])][ALPHABET.index(s[j - 1])]:
            ops.append("=" if q[i - 1] == s[j - 1] else "X")
            i, j = i - 1, j - 1
        elif j == 0 or (i and h[i][j] == h[i - 1][j] - 1):
            ops.append("I")
            i -= 1
        else:
            ops.append("D")
            j -= 1
    return h[end[0]][end[1]], i, end[0], j, end[1], "".join(f"{len(list(g))}{c}" for c, g in itertools.groupby(reversed(ops)))


@data
def test_alignments_equal_the_slow_ones(spark):
    ref = views.reference(spark, SMALL).first()["ref_sequence"]
    texts = {r["doc_id"]: r["seq"] for r in views.seqs(spark, SMALL).collect()}
    kept = {r["doc_id"] for r in registry.QUERIES["sw_filtered"](spark, SMALL).collect()}
    for name, local in (("sw_alignments", True), ("nw_alignments", False)):
        got = {r["doc_id"]: r for r in registry.QUERIES[name](spark, SMALL).collect()}
        assert got.keys() == texts.keys()
        for i, q in texts.items():
            if len(q) > 1500:
                continue
            want, r = slow_alignment(q, ref, local), got[i]
            assert (r["score"], r["q_start"], r["q_end"], r["s_start"], r["s_end"], r["cigar"]) == want
            if local:
                columns = sum(int(n) for n, _ in _ops(want[5]))
                inserted = sum(int(n) for n, c in _ops(want[5]) if c == "D")
                same = sum(int(n) for n, c in _ops(want[5]) if c == "=")
                assert (i in kept) == (want[0] >= 24 and 100.0 * same / max(1, columns - inserted) >= 60)


def _ops(text):
    import re

    return re.findall(r"(\d+)(\D)", text)


def test_published_scores():
    m = blosum62().rows
    assert (m == m.T).all() and np.diag(m)[:20].tolist() == [4, 5, 6, 6, 9, 5, 5, 6, 8, 4, 4, 5, 5, 6, 7, 4, 5, 11, 7, 4]
    at = lambda a, b: int(m[PUBLISHED_ORDER.index(a), PUBLISHED_ORDER.index(b)])
    known = {"WY": 2, "IV": 3, "KR": 2, "DE": 2, "CW": -2, "GI": -4, "FY": 3, "ST": 1, "LM": 2, "PF": -4, "BD": 4, "ZE": 4, "*A": -4, "**": 1}
    assert {p: at(*p) for p in known} == known


def test_matrices_from_a_rule():
    p = np.full(20, 0.05)
    step = np.full((20, 20), 0.01 / 19)
    np.fill_diagonal(step, 0.99)
    near, far = point_accepted("a", step, p, 10).rows, point_accepted("a", step, p, 200).rows
    assert (near == near.T).all() and near[0, 0] > far[0, 0] > 0 >= far[0, 1] > near[0, 1]
    even = log_odds("e", np.outer(p, p), p).rows
    assert (even[:23, :23] == 0).all() and even[23, 23] == 1


def random_model(rng, size, gaps=False):
    norm = lambda x: np.log(x / x.sum(-1, keepdims=True))
    moves = rng.random((size + 1, 7)) + 0.1
    moves = np.concatenate([norm(moves[:, :3]), norm(moves[:, 3:5]), norm(moves[:, 5:])], axis=1)
    if gaps:
        moves[0, 6] = moves[1, 6] = -np.inf
    return hmm.Model(norm(rng.random((size, 24))), norm(rng.random((size + 1, 24))), moves)


def every_path(model, x):
    """(log probability, path, states) of every way through a model, by recursion."""
    size, out = len(model.match), []

    def go(state, k, t, p, path):
        if k == size and t == len(x):
            out.append((p, path))
        move = dict(zip(hmm.TRANSITIONS, model.transitions[k]))
        if k < size and t < len(x):
            go("m", k + 1, t + 1, p + move[state + "m"] + model.match[k, x[t]], path + "M")
        if t < len(x) and state != "d":
            go("i", k, t + 1, p + move[state + "i"] + model.insert[k, x[t]], path + "I")
        if k < size and state != "i":
            go("d", k + 1, t, p + move[state + "d"], path + "D")

    go("m", 0, 0, 0.0, "")
    return [(p, w) for p, w in out if p > -np.inf]


@pytest.mark.parametrize("gaps", [False, True])
def test_models_equal_the_sum_over_all_paths(gaps):
    rng = np.random.default_rng(5)
    for size, length in ((1, 1), (2, 3), (3, 2), (3, 4), (2, 0)):
        model = random_model(rng, size, gaps)
        x = rng.integers(0, 22, length)
        ways = every_path(model, x)
        if not ways:
            assert hmm.forward_batch(model, x[None, :])[0] == -math.inf
            continue
        total = math.log(sum(math.exp(p) for p, _ in ways))
        score, path = hmm.viterbi_batch(model, x[None, :])
        assert score[0] == pytest.approx(max(ways)[0]) and path[0] == max(ways)[1]
        assert hmm.forward_batch(model, x[None, :])[0] == pytest.approx(total)
        back = hmm.backward_rows(model, x[None, :])
        assert back[0][0][0, 0] == pytest.approx(total)
        text = "".join(ALPHABET[c] for c in x)
        emitted, taken, likelihood, n = hmm.expected_counts(model, [text, text])
        assert likelihood == pytest.approx(2 * total) and n == 2
        want, moves = np.zeros_like(emitted), np.zeros_like(taken)
        for p, w in ways:
            share, state, k, t = 2 * math.exp(p - total), "m", 0, 0
            for c in w.lower():
                moves[k, hmm.TRANSITIONS.index(state + c)] += share
                k, t, state = k + (c != "i"), t + (c != "d"), c
                if c == "m":
                    want[k - 1, x[t - 1]] += share
        assert np.allclose(emitted, want) and np.allclose(taken, moves)


@data
def test_words_against_their_own_models(spark):
    rows = views.msa(spark, SMALL).where("seq_idx % 97 = 0").collect()
    got = {r["seq_idx"]: r for r in registry.QUERIES["hmm_scores"](spark, SMALL).collect()}
    models = hmm.collect_models(hmm.emissions(views.msa(spark, SMALL)))
    assert len(got) == views.msa(spark, SMALL).count()
    for r in rows[:200]:
        score, path = hmm.viterbi(models[r["msa_id"]], r["sequence"])
        x = got[r["seq_idx"]]
        assert (x["msa_id"], x["path"]) == (r["msa_id"], path) and x["viterbi"] == pytest.approx(score, abs=1e-6) and x["forward"] == pytest.approx(hmm.forward(models[r["msa_id"]], r["sequence"]), abs=1e-6)


def test_training_of_many_models(spark):
    rng = np.random.default_rng(7)
    models = {k: random_model(rng, 4) for k in "ab"}
    rows = [(k, "".join(rng.choice(list("ARND"), rng.integers(2, 7)))) for k in "ab" for _ in range(30)]
    df = spark.createDataFrame(rows + [("c", "AAA"), ("a", None)], "msa_id string, sequence string").repartition(3)
    trained, seen = hmm.train(df, models, rounds=4)
    for k in "ab":
        own, likelihood = hmm.baum_welch(models[k], [s for x, s in rows if x == k] + ([""] if k == "a" else []), rounds=4)
        assert seen[k] == pytest.approx(likelihood) and all(b >= a - 0.05 for a, b in zip(likelihood, likelihood[1:])) and likelihood[-1] > likelihood[0]
        assert np.allclose(trained[k].match, own.match) and np.allclose(trained[k].transitions, own.transitions)


BODY = """HMMER3/f
NAME  tiny
LENG  2
HMM A C
  m->m m->i m->d i->m i->i d->m d->d
  COMPO 0.7 0.7
  0.7 0.7
  0.1 2.5 4.0 0.6 0.8 0.0 *
  1 0.2 1.8
  0.7 0.7
  0.1 2.5 4.0 0.6 0.8 0.6 0.8
  2 1.8 0.2
  0.7 0.7
  0.1 2.5 * 0.6 0.8 0.0 *
//
"""


def test_search_with_a_model_from_a_file(spark, tmp_path):
    from strandloom.sources import models

    (tmp_path / "x.hmm").write_text(BODY)
    body = models.read_bodies(spark, str(tmp_path)).first().asDict()
    model = hmm.Model.from_body(body)
    found = {r["sequence"]: r for r in hmm.search(spark.createDataFrame([("AC",), ("CA",), ("AAC",), ("W",), ("",)], "sequence string"), model).collect()}
    assert found["AC"]["path"] == "MM" and found["AC"]["viterbi"] == pytest.approx(-0.1 - 0.2 - 0.1 - 0.2)
    assert found["AC"]["viterbi"] > found["CA"]["viterbi"] and found["W"]["viterbi"] == -math.inf and found["W"]["path"] == ""
    for s in ("CA", "AAC"):
        ways = every_path(model, hmm.encode(s))
        assert found[s]["viterbi"] == pytest.approx(max(ways)[0]) and found[s]["forward"] == pytest.approx(math.log(sum(math.exp(p) for p, _ in ways)))


def test_pairs_in_blocks_equal_the_slow_ones(spark, monkeypatch):
    monkeypatch.setattr(pairwise, "BLOCK", 4)
    rng = random.Random(3)
    rows = [(f, i, "".join(rng.choices("AC-", k=rng.randint(0, 9)))) for f, n in (("x", 19), ("y", 3), ("z", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "msa_id string, seq_idx int, sequence string")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in pairwise.pairwise(df).collect()}
    want = {}
    for (f, i, a), (g, j, b) in itertools.combinations(rows, 2):
        if f == g:
            n = max(len(a), len(b))
            pairs = list(zip(a.ljust(n, "-"), b.ljust(n, "-")))
            want[f, i, j] = (sum(x != y for x, y in pairs), sum(x != y and "-" not in (x, y) for x, y in pairs), n)
    assert got == want
    with pytest.raises(ValueError, match="x: 19 rows"):
        pairwise.pairwise(df, most=10)


def test_trees_equal_the_slow_ones():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 5, 9):
        d = rng.integers(1, 6, (n, n)).astype(float)
        d = np.triu(d, 1) + np.triu(d, 1).T
        names = [f"s{i}" for i in range(n)]
        alive, size, height, text = list(range(n)), [1] * n, [0.0] * n, list(names)
        dist = {(i, j): d[i, j] for i in range(n) for j in range(n)}
        while len(alive) > 1:
            a, b = min(itertools.combinations(alive, 2), key=lambda p: dist[p])
            new = len(size)
            size.append(size[a] + size[b])
            height.append(dist[a, b] / 2)
            text.append(f"({text[a]}:{height[new] - height[a]:.6f},{text[b]}:{height[new] - height[b]:.6f})")
            alive = [x for x in alive if x not in (a, b)]
            for x in alive:
                dist[x, new] = dist[new, x] = (dist[a, x] * size[a] + dist[b, x] * size[b]) / size[new]
            alive.append(new)
        assert trees.newick(trees.upgma(names, d)) == text[alive[0]] + ";"
        # neighbour joining gives back the distances of a tree
        tree = trees.upgma(names, d)
        for x in tree:
            x["branch_length"] = float(rng.integers(1, 9))
        apart = path_lengths(tree, names)
        assert np.allclose(path_lengths(trees.neighbour_joining(names, apart), names), apart)
        rows = {s: "".join(rng.choice(list("ACG-"), rng.integers(3, 6))) for s in names}
        cost, found = trees.ancestors(tree, rows)
        width = max(map(len, rows.values()))
        by_column = [trees.fitch(tree, {s: (r[k] if k < len(r) else "-") for s, r in rows.items()}) for k in range(width)]
        assert cost == sum(c for c, _ in by_column) == trees.parsimony_cost(tree, rows)
        assert found == {i: "".join(states[i] for _, states in by_column) for i in found}


def path_lengths(tree, names):
    up = {}
    for name in names:
        at, far, seen = next(x for x in tree if x["name"] == name), 0.0, {}
        while True:
            seen[at["node_id"]] = far
            if at["parent"] is None:
                break
            far += at["branch_length"]
            at = tree[at["parent"]]
        up[name] = seen
    return np.array([[min(up[a][k] + up[b][k] for k in up[a].keys() & up[b].keys()) for b in names] for a in names])


@data
def test_trees_of_whole_families(spark):
    leaves = registry.QUERIES["tree_nodes"](spark, SMALL).where("name is not null").collect()
    assert sorted((r["tree_id"], r["name"]) for r in leaves) == sorted((r["msa_id"], f"seq{r['seq_idx']}") for r in views.families(spark, SMALL).collect())
    for name in ("upgma_trees", "neighbour_joining_trees"):
        for r in registry.QUERIES[name](spark, SMALL).collect():
            assert r["newick"].count("(") == r["newick"].count(")") and r["newick"].endswith(";")
    with pytest.raises(ValueError, match="at most 3"):
        trees.tree_texts(views.families(spark, SMALL), most=3)


def test_text_of_a_deep_tree():
    tree = trees.upgma([f"s{i}" for i in range(3)], trees.distances(["AAAA", "AAAC", "CCCC"]))
    assert trees.newick(tree) == "(s2:0.437500,(s0:0.125000,s1:0.125000):0.312500);"
    deep = [{"node_id": 0, "parent": None, "name": "s0", "branch_length": 1.0, "children": []}]
    for i in range(1, 5001):
        deep.append({"node_id": i, "parent": None, "name": None, "branch_length": 1.0, "children": [i - 1]})
        deep[i - 1]["parent"] = i
    assert trees.newick(deep).startswith("(" * 5000 + "s0:1.000000)")


def test_tokens_beyond_an_int(spark):
    from strandloom.sources import models

    rows = spark.createDataFrame([("*-4000007872",), ("*4000007872",), ("*-12",), ("-4000001000",), ("*x",)], "t string")
    assert [r[0] for r in rows.select(models.score_token("t")).collect()] == [-4000007.872, 4000007.872, -0.012, -4000001.0, None]


def test_alignments_of_nothing(spark, tmp_path):
    rows = [(1, "P"), (2, "W"), (3, "PPP www"), (4, "G"), (5, "east")]
    spark.createDataFrame([(i, t, "en", "x") for i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(views.REFERENCE_KEY, "MIDDLE EAST")], "r_regionkey long, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    got = registry.QUERIES["sw_alignment_invariants"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(all(r[1:]) for r in got)


def test_trees_of_thousands(spark, monkeypatch):
    rng = random.Random(4)
    rows = [("f", i, "".join(rng.choices("ACDE", k=12))) for i in range(5_100)]
    nodes = trees.build_trees(spark.createDataFrame(rows, "msa_id string, seq_idx int, sequence string"), "upgma").collect()
    assert len(nodes) == 2 * len(rows) - 1 and sum(r["parent"] is None for r in nodes) == 1
    found = trees.tree_texts(spark.createDataFrame(rows, "msa_id string, seq_idx int, sequence string"), "upgma").collect()
    assert len(found) == 1 and found[0]["newick"].count("seq") == len(rows)
    names, texts = [str(i) for i in range(300)], [r[2] for r in rows[:300]]
    for make in (trees.upgma, trees.neighbour_joining):
        want = make(names, trees.distances(texts))
        with monkeypatch.context() as m:
            m.setattr(trees, "IN_MEMORY", 0)
            assert make(names, trees.distances(texts), own=True) == want


def test_neighbour_joining_looks_at_few_rows():
    import time

    rng = np.random.default_rng(6)
    points = rng.random((2_000, 5))
    d = np.abs(points[:, None] - points[None, :]).sum(2)
    began = time.process_time()
    tree = trees.neighbour_joining([str(i) for i in range(2_000)], d)
    assert len(tree) == 2 * 2_000 - 2 and time.process_time() - began < 15  # it took 32 s of a core on texts
    # every join is the best one, by the criterion worked out anew
    points, names = points[:40], [str(i) for i in range(40)]
    d = np.abs(points[:, None] - points[None, :]).sum(2)
    at = {i: i for i in range(40)}
    for n in trees.neighbour_joining(names, d)[40:-1]:
        k, total = len(d), d.sum(1)
        q = (k - 2) * d - total[:, None] - total[None, :]
        np.fill_diagonal(q, np.inf)
        a, b = (at[c] for c in n["children"])
        assert q[a, b] == pytest.approx(q.min())
        row = (d[a] + d[b] - d[a, b]) / 2
        rest = np.delete(np.arange(k), [a, b])
        d = np.block([[d[np.ix_(rest, rest)], row[rest][:, None]], [row[rest][None, :], np.zeros((1, 1))]])
        of = {v: c for c, v in at.items()}
        at = {of[r]: x for x, r in enumerate(rest)} | {n["node_id"]: k - 2}


def test_sums_over_all_pairs_of_large_families(spark, monkeypatch):
    from collections import Counter

    from strandloom.operators import evolution

    rng = random.Random(8)
    rows = [("x", i, "".join(rng.choices("ACD-", k=rng.randint(2, 4)))) for i in range(20_100)] + [("y", 1, "AAAA"), ("y", 2, "AAAC"), ("z", 1, "A")]

    def worth(a, b):
        p = sum(x != y and "-" not in (x, y) for x, y in zip(a, b)) / max(len(a), len(b))
        d = -0.75 * math.log(max(1 - 4 * p / 3, 0.001))
        return math.log(1 - d) if p < 0.75 and d < 1 else 0.0

    kinds = Counter(r[2] for r in rows if r[0] == "x")
    want = sum(worth(a, b) * (n * m if a != b else n * (n - 1)) for a, n in kinds.items() for b, m in kinds.items()) / 2
    df = spark.createDataFrame(rows, "msa_id string, seq_idx int, sequence string")
    got = dict(map(tuple, evolution.pair_log_score(df).collect()))
    assert got == {"x": pytest.approx(want), "y": pytest.approx(worth("AAAA", "AAAC"))}
    monkeypatch.setattr(pairwise, "SUM_ROWS", 4)
    few = dict(map(tuple, evolution.pair_log_score(df.where("seq_idx < 30")).collect()))
    first = [r[2] for r in rows[:30]]
    assert few["x"] == pytest.approx(sum(worth(a, b) for a, b in itertools.combinations(first, 2)))


@pytest.mark.parametrize("sent", [1, 1 << 24])
def test_searches_equal_the_slow_ones(spark, monkeypatch, sent):
    from strandloom.operators import evolution, profile

    monkeypatch.setattr(pairwise, "SENT_LETTERS", sent * 40)
    monkeypatch.setattr(pairwise, "BATCH_PAIRS", 50)
    rng = random.Random(9)
    rows = [(f, i, "".join(rng.choices("ACé-" if i > 60 else "AC-", k=rng.randint(1, 9)))) for f, n in (("x", 120), ("y", 5), ("z", 1)) for i in range(n)] + [("z", 7, None)]
    df = spark.createDataFrame(rows, "msa_id string, seq_idx int, sequence string").repartition(3)
    asked = df.seq_idx % 50 == 0
    want = {}
    for (f, i, a), (g, j, b) in itertools.product(rows, rows):
        if f == g and i % 50 == 0 and i != j and a and b:
            n = max(len(a), len(b))
            pairs = list(zip(a.ljust(n, "-"), b.ljust(n, "-")))
            p = sum(x != y and "-" not in (x, y) for x, y in pairs) / n
            want[f, i, j] = (sum(x != y for x, y in pairs) / n, -0.75 * math.log(max(1 - 4 * p / 3, 0.001)))
    near = {tuple(r)[:3]: r["distance"] for r in profile.distance_searches(df, asked).collect()}
    far = {tuple(r)[:3]: r["distance"] for r in evolution.jukes_cantor_searches(df, asked).collect()}
    assert near == {k: pytest.approx(v[0]) for k, v in want.items()} and far == {k: pytest.approx(v[1]) for k, v in want.items()}


def test_pairs_of_large_families_are_not_refused(spark):
    df = spark.range(20_001).selectExpr("'x' AS msa_id", "id AS seq_idx", "'AC' AS sequence")
    assert pairwise.pairwise(df).schema.fieldNames()[:3] == ["msa_id", "i", "j"]
    assert pairwise.against_all(df, df.seq_idx % 10_000 == 0, "differ", lambda n, width: n / width).count() == 3 * 20_000

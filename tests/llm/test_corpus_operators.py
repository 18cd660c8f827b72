"""Small tables with nulls, empty and long texts, ties, repeated rows, clashing names; brute force beside each operator."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
public_tokenizers = pytest.importorskip("public_tokenizers")


def words_text(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = words_text(rng, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base),
        (2, " ".join(near)),
        (3, base.upper() + "!"),
        (4, words_text(rng, 80)),
        (5, None),
        (6, ""),
        (7, "one two"),
        (8, "One, two."),
        (9, " \n\t "),
        (None, base),
        (None, None),
        (10, words_text(rng, 30_000, 9000)),
        (11, "x" * 20_000),
        (12, "é👍 ▁ � 日本 <|endoftext|> a"),
        (12, "é👍 ▁ � 日本 <|endoftext|> a"),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", None) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns named as the operators name their own."""
    from pyspark.sql import functions as F

    for c in ("_k", "_row", "_key", "t", "id", "set_id", "score", "held_out", "predicted", "n_lines", "N_Removed", "token_ids", "tokens", "decoded", "_matches", "contaminated", "key", "_n", "a.b"):
        docs = docs.withColumn(c, F.lit(1))
    return docs


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- exact top-k search


def brute_top(rows, k):
    out = []
    for q, qv in rows:
        found = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in rows if i != q and len(v) == len(qv)))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_k_is_exact_with_ties(spark):
    from strandloom.llm.ball_tree import quantised, top_k

    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.25, rng.random()]) for _ in range(4)]) for i in range(400)]
    rows += [(i, [0.5] * 4) for i in range(400, 500)]
    bad = [(900, None), (901, [None, 1.0, 1.0, 1.0]), (902, [float("nan")] * 4), (903, [float("inf")] * 4), (None, [1.0] * 4), (904, []), (905, [1.0] * 3)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    vectors = quantised(df, "vec_id", "embedding")
    got = sorted(tuple(r) for r in top_k(vectors, vectors.where("vec_id % 25 = 0"), k=7, shard_rows=60, block_bytes=500).collect())
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    assert got == [r for r in brute_top(whole, 7) if r[0] % 25 == 0]


def test_top_k_of_repeated_rows_and_shared_scores(spark, monkeypatch):
    from pyspark.sql import functions as F

    from strandloom.llm import ball_tree as m

    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(3000)]
    rows += rows[:40] + [(i, [9.0] * 6) for i in range(100, 130)]  # repeated rows, and other vectors under known ids
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumn("v", F.lit("clash")).withColumn("score", F.lit(1))
    vectors = m.quantised(df, "vec_id", "embedding")
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    first = {}
    for i, v in whole:
        first[i] = min(first.get(i, v), v)
    want = []
    for q in range(0, 3000, 100):
        found = sorted(((-sum(a * b for a, b in zip(first[q], v)), i) for i, v in whole if i != q))[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    asked = vectors.where("vec_id % 100 = 0")
    assert sorted(map(tuple, m.top_k(vectors, asked, shard_rows=200).collect())) == want

    # later shards of a task start from the score of those before
    opened = []
    search = m.BallTree.search
    monkeypatch.setattr(m.BallTree, "search", lambda self, q, v, k, floor, bounds: opened.append(floor) or search(self, q, v, k, floor, bounds))
    task = m._Search(m._Queries([0], [np.array(first[0])], {}), 10)
    for at in range(0, 3000, 500):
        task.shard(np.array([i for i, _ in whole[at : at + 500]]), np.array([v for _, v in whole[at : at + 500]]))
    known = [f for f in opened if f is not None]
    assert opened[0] is None and known == sorted(known) and len(set(known)) > 1


def test_top_k_empty_and_huge(spark):
    from strandloom.llm.ball_tree import quantised, top_k

    none = quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert top_k(none, none).count() == 0
    big = quantised(spark.createDataFrame([(1, [1e30]), (2, [2.0]), (3, [-1e300])], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert top_k(big, big).where("query_id = 2").count() == 2


# --- sentence pieces


def test_pieces_round_trip_and_viterbi(docs, clashing, empty):
    from strandloom.llm.sentence_pieces import _LITERAL, MARK, _load, decode_pieces, encode_pieces

    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = decode_pieces(encode_pieces(docs, model), model).collect()
    assert len(rows) == 15 and all(r["decoded"] == r["text"] for r in rows)
    assert all(r["token_ids"] == [] for r in rows if not r["text"])
    assert encode_pieces(clashing, model).count() == 15 and encode_pieces(empty, model).count() == 0

    pieces, _, _ = _load(model)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    score = {sp.id_to_piece(int(i)): s for i, s in zip(pieces.ids[:-1], pieces.score)}
    for r in rows:
        if len(r["text"]) > 30_000:
            continue
        x = MARK + r["text"].replace(MARK, _LITERAL).replace(" ", MARK) if r["text"] else ""
        best = [0.0] + [-math.inf] * len(x)
        for e in range(1, len(x) + 1):
            for a in range(max(0, e - 24), e):
                s = score.get(x[a:e], pieces.unknown_score if e - a == 1 else -math.inf)
                best[e] = max(best[e], best[a] + s)
        assert r["score"] == pytest.approx(best[-1])
        ids = [sp.id_to_piece(i) for i in r["token_ids"]]
        if not any(p.startswith("<0x") for p in ids):
            assert "".join(ids) == x and sum(score[p] for p in ids) == pytest.approx(best[-1])


def test_long_words_equal_the_slow_search(monkeypatch):
    from strandloom.llm import sentence_pieces as m

    rng = random.Random(4)
    known = [(p, -rng.random() * 9) for p in {"".join(rng.choices("abcd", k=rng.randint(1, 4))) for _ in range(60)}]
    pieces = m.Pieces(known, list(range(len(known))), {}, 99)
    score = dict(known)
    monkeypatch.setattr(m, "LONG_WORD", 5)
    for _ in range(60):
        words = ["".join(rng.choices("abcdz", weights=[9, 9, 2, 2, 1], k=rng.randint(1, 60))) for _ in range(rng.randint(1, 6))]
        ids, got = pieces.viterbi(words)
        for w, x, s in zip(words, ids, got):
            best = [0.0] + [-math.inf] * len(w)
            for e in range(1, len(w) + 1):
                best[e] = max(best[a] + score.get(w[a:e], pieces.unknown_score if e - a == 1 else -math.inf) for a in range(max(0, e - 4), e))
            assert s == pytest.approx(best[-1])
            assert sum(score[known[i][0]] if i < 99 else pieces.unknown_score for i in x) == pytest.approx(s)


def test_ranks_only_where_the_file_says_merges():
    from strandloom.llm.sentence_pieces import BPE, UNIGRAM, Pieces, model_type

    blob = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    assert model_type(blob) == BPE and model_type(b"") == UNIGRAM
    whole = [("a", -1.0), ("b", -2.0), ("ab", -4.0)]
    assert Pieces(whole, [0, 1, 2], {}, 3).score.tolist()[:3] == [-1.0, -2.0, -4.0]
    assert Pieces(whole, [0, 1, 2], {}, 3, ranks=True).score.tolist()[:3] == pytest.approx([-math.log(3), -math.log(4), -math.log(6)])


def test_decode_of_odd_ids(spark):
    from strandloom.llm.sentence_pieces import decode_pieces

    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = spark.createDataFrame([(None,), ([],), ([-1, 10**6],)], "token_ids array<int>")
    assert [r["decoded"] for r in decode_pieces(rows, model).collect()] == [None, "", ""]


# --- private data


def naive_spans(text):
    from strandloom.llm.sanitise import luhn

    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 0) or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 14 <= len(d) <= 19 and luhn(d)) or (k == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return [(a, b, ("email", "ip", "card", "phone")[k]) for a, k, b in sorted(out)]


def test_spans_are_those_of_the_patterns():
    from strandloom.llm.sanitise import base_spans

    rng = random.Random(3)
    parts = ["a", "b@", "@", "c.de", ".", "-", "1", "23", "255", "300", "+", "(", ")", " ", "4111111111111111", "+1 (017) 555-7713", "x@y.z", "1.2.3.4", "é", "٣"]
    for _ in range(8000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert base_spans(t) == naive_spans(t)
    assert base_spans("9" * 200_000) == [] and base_spans("a" * 200_000 + "@") == []


def test_private_terms_and_sanitising(spark, docs, clashing, empty):
    from strandloom.llm.sanitise import find_private, sanitise

    rng = random.Random(2)
    rows = [(i, f"{words_text(rng, 20, 30)} {'mailbox ' if i % 10 == 0 else ''}{f'joe{i}@mail.org' if i % 10 == 0 else 'nobody'} {words_text(rng, 20, 30)}", "en", "s", 0) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    found = find_private(df)
    got = {r["id"]: r for r in found.collect()}
    for i, text, *_ in rows:
        spans = [(s["s"], s["e"], s["kind"]) for s in got[i]["spans"]]
        base = naive_spans(text)
        assert [s for s in spans if s[2] != "term"] == base
        assert {text[a:b] for a, b, k in spans if k == "term"} == ({"mailbox"} if i % 10 == 0 else set())
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
    clean = {r["doc_id"]: r["text"] for r in sanitise(df, found).collect()}
    assert "[email]" in clean[10] and "mailbox" not in clean[10] and clean[11] == rows[11][1]
    assert find_private(clashing).count() == 15 and find_private(empty).count() == 0
    assert {r["id"] for r in find_private(docs).collect()} == {None, *range(1, 13)}


# --- similarity join


def brute_join(rows, t=0.8, n=5):
    from strandloom.llm.shingles import words

    sets = []
    for _, text in rows:
        w = words(text or "")
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    root, links = list(range(len(rows))), Counter()

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[top(a)] = top(b)
    return [top(i) for i in range(len(rows))], links


def check_join(rows, got):
    root, links = brute_join(rows)
    ids = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            ids[r] = min(ids.get(r, i), i)
    want = sorted((str(i), str(ids.get(r)), links[k]) for k, ((i, _), r) in enumerate(zip(rows, root)))
    assert sorted((str(r["id"]), str(r["class_id"]), r["n_links"]) for r in got) == want


def test_join_equals_brute_force(texts, docs, clashing, empty):
    from strandloom.llm.jaccard_join import choose_bands, jaccard_join

    check_join(texts, jaccard_join(docs).collect())
    assert jaccard_join(clashing).count() == 15 and jaccard_join(empty).count() == 0
    bands, rows = choose_bands(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128


def test_join_of_a_cluster_cut_into_blocks(spark, monkeypatch):
    from strandloom.llm import jaccard_join as jj

    monkeypatch.setattr(jj, "BLOCK", 8)
    rng = random.Random(9)
    base = words_text(rng, 100, 10_000).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(100)] = f"e{rng.randrange(99999)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, words_text(rng, 60, 10_000)) for i in range(20)]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS)
    check_join(rows, jj.jaccard_join(df).collect())


def test_join_of_a_chain_of_weak_collisions(spark, monkeypatch):
    from strandloom.llm import jaccard_join as jj

    rng = random.Random(10)
    base = words_text(rng, 1500, 100_000).split()
    rows = [(i, " ".join(base[20 * i : 20 * i + 100])) for i in range(70)]  # neighbours at 0.65: they meet in bands, and aren't linked
    rows += [(100 + i, " ".join(base[20 * i : 20 * i + 100] + ["more", str(i)])) for i in range(0, 70, 5)]
    rows += [(200 + i, " ".join(base[20 * i + 2 : 20 * i + 100])) for i in range(0, 70, 7)]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS)
    seen = []
    by_bands = jj._by_bands
    monkeypatch.setattr(jj, "BLOCK", 16)
    monkeypatch.setattr(jj, "_by_bands", lambda sets: seen.append(sets.count()) or by_bands(sets))
    check_join(rows, jj.jaccard_join(df).collect())
    assert seen[0] > 16
    monkeypatch.setattr(jj, "BLOCK", 1024)
    monkeypatch.setattr(jj, "BLOCK_SHINGLES", 500)
    check_join(rows, jj.jaccard_join(df).collect())


def test_few_pairs_a_step_count_the_same(monkeypatch):
    from fractions import Fraction

    import numpy as np

    from strandloom.llm import jaccard_join as jj

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(50)]
    want = np.array([[a != b and 2 * len(np.intersect1d(x, y)) >= len(np.union1d(x, y)) for b, y in enumerate(sets)] for a, x in enumerate(sets)])
    for step in (1, 1 << 20):
        monkeypatch.setattr(jj, "STEP", step)
        assert (jj._links(sets, 50, Fraction(1, 2)) == want).all()
        assert (jj._links(sets, 20, Fraction(1, 2)) == want[:20, 20:]).all()


def test_one_of_each_class_stays(spark, texts, docs, clashing, empty):
    from strandloom.llm.jaccard_join import keep_one

    kept = keep_one(docs).collect()
    assert kept[0].asDict().keys() == dict.fromkeys(docs.columns).keys()
    left = Counter(r["doc_id"] for r in kept)
    assert left[None] == 2 and not left.keys() & {1, 2, 3, 8} and left[7] == left[12] == 1  # the null id is the smallest
    assert {4, 5, 6, 7, 9, 10, 11} <= left.keys()
    assert keep_one(clashing).count() == len(kept) and keep_one(empty).count() == 0


def test_components(spark):
    from strandloom.llm.components import components

    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200 + i, 199) for i in range(50)] + [(500, 500)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u int, v int")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != 500}
    assert components(spark.createDataFrame([], "u int, v int")).count() == 0


def test_a_hot_key_stays_where_it_is(spark):
    from strandloom.llm.common import join_hot

    many = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k", "id AS x")
    one = many.groupBy("k").count().selectExpr("k", "k + 1 AS m", "count AS _n")
    got = join_hot(many, one, "k", 5000)
    assert got.columns == ["k", "x", "m"] and sorted((r["x"], r["m"]) for r in got.collect()) == [(i, 0 if i % 3 == 0 else i + 1) for i in range(5000)]


# --- decontamination


def slow_tiling(item, text, n):
    """Greedy string tiling by search: the longest unmarked match, first in the item, then in the text."""
    im, tm, tiles = [False] * len(item), [False] * len(text), []
    while True:
        best = (n - 1, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                k = 0
                while p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k] and not im[p + k] and not tm[t + k]:
                    k += 1
                if k > best[0]:
                    best = (k, p, t)
        if best[0] < n:
            return sum(k for k, _, _ in tiles)
        k, p, t = best
        tiles.append(best)
        im[p : p + k] = [True] * k
        tm[t : t + k] = [True] * k


def test_tiles_equal_the_slow_search():
    from strandloom.llm.decontaminate import Items
    from strandloom.llm.shingles import words

    rng = random.Random(8)
    for _ in range(120):
        item = " ".join(rng.choices("abcdef", k=rng.randint(5, 25)))
        text = " ".join(rng.choices("abcdef", k=rng.randint(0, 40)))
        found = Items([(1, item)], 3).matches(text)
        covered = slow_tiling(words(item), words(text), 3)
        assert (found[0][1] if found else 0.0) == pytest.approx(covered / len(words(item)))


def test_tiles_of_long_repetitions_take_no_pairs():
    import time

    from strandloom.llm.decontaminate import Items

    began = time.time()
    assert Items([(1, "so " * 200)], 5).matches("so " * 20_000) == [(1, 1.0, 1)]
    assert Items([(1, "so it goes " * 60)], 5).matches("so it goes on " * 5_000) == []
    assert Items([(1, "so it goes " * 60)], 5).matches("so it goes so it goes on " * 3_000) == [(1, 1.0, 30)]
    assert time.time() - began < 5


def test_leaks_of_short_items(spark):
    from strandloom.llm.decontaminate import find_leaks

    bench = spark.createDataFrame([(1, "four words of text"), (2, "word!"), (3, "..."), (4, "")], "item_id long, text string")
    texts = ["Here: four words, of TEXT.", "of text four words", "a word", "... ", None]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: [(m["item_id"], m["coverage"]) for m in r["_matches"]] for r in find_leaks(df, bench).collect()}
    assert got == {0: [(1, 1.0)], 1: [], 2: [(2, 1.0)], 3: [], 4: []}


def test_leaks_also_in_another_order(spark, docs, clashing, empty):
    from strandloom.llm.decontaminate import find_leaks

    rng = random.Random(6)
    item = words_text(rng, 40, 5000).split()
    moved = item[20:] + ["between"] + item[:20]
    rows = [(1, " ".join(["before", *item, "after"]).upper()), (2, " ".join(moved)), (3, " ".join(item[:20])), (4, "other words here"), (5, None)]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS)
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None), (None, "a b c d e f"), (10, None)], "item_id long, text string")
    for most in (1 << 20, 100):  # in one block, and in several
        got = {r["doc_id"]: (r["contaminated"], [(m["item_id"], round(m["coverage"], 3)) for m in r["_matches"]]) for r in find_leaks(df, bench, most=most).collect()}
        assert got == {1: (True, [(7, 1.0)]), 2: (True, [(7, 1.0)]), 3: (False, [(7, 0.5)]), 4: (False, []), 5: (False, [])}
    assert find_leaks(clashing, bench).count() == 15 and find_leaks(empty, bench).count() == 0
    assert find_leaks(docs, bench.limit(0)).where("contaminated").count() == 0


# --- line dedup


def brute_lines(rows, lines=3):
    """Rows (id, text), distinct; the first occurrence by id, then place."""
    seen, gone = set(), {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        x = (rows[i][1] or "").split("\n")
        gone[i] = set()
        for p in range(len(x) - lines + 1):
            w = tuple(x[p : p + lines])
            if w in seen:
                gone[i] |= set(range(p, p + lines))
            seen.add(w)
    return [None if rows[i][1] is None else "\n".join(y for k, y in enumerate(rows[i][1].split("\n")) if k not in gone[i]) for i in range(len(rows))]


def test_lines_equal_brute_force(spark, docs, clashing, empty):
    from strandloom.llm.line_dedup import dedup_lines

    rng = random.Random(7)
    rows = [(i, "\n".join(rng.choices(["a", "b", "c", "", "dd"], k=rng.randint(1, 30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (None, "a\nb\nc\nd")]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS)
    got = {r["doc_id"]: r["text"] for r in dedup_lines(df).collect()}
    assert got == dict(zip((i for i, _ in rows), brute_lines(rows)))
    twice = dedup_lines(df.unionByName(df)).groupBy("doc_id").count().where("count <> 2").count()
    assert twice == 0 and dedup_lines(df.unionByName(df)).where("text is not null").count() == 2 * (len(rows) - 1)
    assert dedup_lines(clashing).count() == 15 and dedup_lines(empty).count() == 0


# --- toxicity


def test_toxicity_on_held_out_rows_and_misspellings(spark, docs, clashing, empty):
    from strandloom.llm.toxicity import fit_toxicity, score_toxicity

    rng = random.Random(1)
    bad = ["stupidhead", "worthlessly", "disgustingo"]
    rows, labels = [], []
    for i in range(600):
        w = words_text(rng, 60, 300).split()
        if i % 4 == 0:
            for _ in range(5):
                w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w), "", "", 0))
        labels.append((i, None, int(i % 4 == 0)))
    labels += [(None, 1, 1), (5000, 1, None), (3, 0, 0)]
    df = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = fit_toxicity(df, marks)
    got = {r["doc_id"]: r for r in score_toxicity(df, model).collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert sum(got[i]["predicted"] == int(i % 4 == 0) for i in held) / len(held) > 0.97
    unseen = spark.createDataFrame([(1, "w1 w2 stupidheads worthlesslly w3 disgustingoo w7 w8", "", "", 0), (2, "w1 w2 w3 w4", "", "", 0)], DOCS)
    s = {r["doc_id"]: r["score"] for r in score_toxicity(unseen, model).collect()}
    assert s[1] > s[2]
    every = score_toxicity(docs, model).collect()
    assert len(every) == 15 and all(0 <= r["score"] <= 1 for r in every)
    assert score_toxicity(clashing, model).count() == 15 and score_toxicity(empty, model).count() == 0
    nothing = fit_toxicity(empty, marks.limit(0))
    assert all(r["predicted"] == 0 for r in score_toxicity(docs, nothing).collect())


# --- preferences


def test_preferences(spark):
    from strandloom.llm.preferences import conversations, format_preferences, swapped_pairs

    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_end|>"), (2, 0, None, None), (2, 1, "assistant", "ok"), (3, 0, "user", "only"), (None, 0, "user", "x"), (1, 1, "assistant", "yo <|im_end|>")]
    convs = conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["pair_id"]: r for r in format_preferences(swapped_pairs(convs)).collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert one["n_common"] == 2 and one["prompt"].count("<|im_start|>") == 2 and "<\\|im_end|>" in one["chosen"]
    for side in ("chosen", "rejected"):
        assert [one[side][m["s"] : m["e"]] for m in one[f"{side}_mask"]] == [("yo <\\|im_end|>" if side == "chosen" else "ok") + "<|im_end|>\n"]
    assert got[3]["chosen"] == got[3]["rejected"] == "" and got[2]["rejected"] == ""
    odd = spark.createDataFrame([(None, None, [("user", "a")]), (5, [], [])], "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    assert sorted((r["n_common"], r["prompt"], r["chosen"]) for r in format_preferences(odd).collect()) == [(0, "", ""), (0, "", "")]


# --- language model


def test_language_model_base_and_normalisation(spark, texts, docs, clashing, empty):
    from strandloom.llm.log_bilinear import score_texts

    train = [t or "" for i, t in texts if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    toks = lambda t: re.findall(r"[^\x20\x09-\x0D]+", low(t))
    c = Counter(w for t in train for w in toks(t))
    n, v = sum(c.values()) + len(train), len(c) + 1
    for hot in (100_000, 20):
        got = sorted(score_texts(docs, hot_tokens=hot).collect(), key=str)
        assert len(got) == 15
        want = {}
        for i, t in texts:
            w = toks(t or "")
            want.setdefault(i, []).append((len(w) + 1, sum(c[x] > 0 for x in w) + 1, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))))
        for r in got:
            assert r["train_tokens"] == n and r["score"] <= 0
            assert any((r["n_tokens"], r["n_known"]) == x[:2] and r["base_score"] == pytest.approx(x[2]) for x in want[r["doc_id"]])
    assert score_texts(clashing).count() == 15 and score_texts(empty).count() == 0


def slow_log10(model, two, one):
    """log10 of the probability of every symbol after two, from the parameters, one number at a time."""
    h = [sum(float(model.context[one][i] * model.near[i][j] + model.context[two][i] * model.far[i][j]) for i in range(model.dim)) for j in range(model.dim)] + [1.0]
    value = lambda row: sum(a * float(b) for a, b in zip(h, row))
    z = [math.exp(value(row)) for row in model.classes]
    own = [math.exp(value(row)) for row in model.target]
    out = []
    for s in range(model.size):
        c = s // model.width
        out.append(math.log10(z[c] / sum(z)) + math.log10(own[s] / sum(own[c * model.width : (c + 1) * model.width])))
    return out


def test_language_model_scores_equal_the_slow_ones(spark, texts, docs, monkeypatch):
    from strandloom.llm import log_bilinear as m

    seen = {}
    fit = m.fit_model

    def spy(counts, vocab, n):
        rows = counts.groupBy("code").agg({"n": "sum"}).collect()
        seen["vocab"], seen["model"], seen["codes"] = vocab, fit(counts, vocab, n), {r[0]: r[1] for r in rows}
        return seen["model"]

    monkeypatch.setattr(m, "fit_model", spy)
    monkeypatch.setattr(m, "OWN_SYMBOLS", 25)
    monkeypatch.setattr(m, "SHARD_TOKENS", 9000)  # several shards
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in m.score_texts(docs, hot_tokens=60).collect()}
    v, model = seen["vocab"], seen["model"]
    train = [t or "" for i, t in texts if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in train for w in m.tokens(t))
    hot = set(v.index)
    bucket = lambda w: int(m.rare_bucket(np.array([len(w)]))[0])
    symbol = lambda w: int(v.symbol[v.index[w]]) if w in hot else int(v.rare_symbol[bucket(w)])
    mass, rare, codes, tables = Counter({v.end: len(train)}), {}, Counter(), {}
    for w, n in count.items():
        mass[symbol(w)] += n
        if w not in hot:
            rare.setdefault(bucket(w), []).append(n)
    assert [mass[k] for k in range(v.size)] == v.mass.tolist()
    for i, t in texts:
        w = m.tokens(t or "")
        s = [v.end, v.end, *map(symbol, w), v.end]
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            codes.update((a * v.size + b) * v.size + c for a, b, c in zip(s, s[1:], s[2:]))
        if len(w) > 500:
            continue
        total = 0.0
        for a, b, c, x in zip(s, s[1:], s[2:], [*w, None]):
            if (a, b) not in tables:
                tables[a, b] = slow_log10(model, a, b)
                assert sum(10**y for y in tables[a, b]) == pytest.approx(1, abs=1e-6)
            total += tables[a, b][c]
            if x in hot:
                total += math.log10(count[x] / mass[c])
            elif x is not None:
                total += math.log10((count[x] + 1) / (sum(rare.get(bucket(x), [])) + len(rare.get(bucket(x), [])) + 1))
        assert got[i, len(w) + 1] == pytest.approx(total, rel=1e-4)
    assert seen["codes"] == codes


def test_language_model_learns_order():
    from strandloom.llm.log_bilinear import LogBilinear, Vocabulary, trigrams

    rng = np.random.default_rng(0)
    s = np.tile([1, 2, 3, 0], 3000)
    s[rng.integers(0, len(s), 600)] = 4
    v = Vocabulary([(bytes([97 + i]), int((s == i + 1).sum())) for i in range(4)], int((s == 0).sum()), {}, len(s), 5)
    number = np.array([v.end, *v.symbol[[v.index[bytes([97 + i])] for i in range(4)]]])
    code, n = np.unique(trigrams(number[s], np.array([len(s)]), v), return_counts=True)
    model = LogBilinear(v).fit(code, n, 300)
    score = model.scorer().score(code)
    unigram = np.log10(v.mass[code % v.size] / len(s))
    assert (n * score).sum() / n.sum() > (n * unigram).sum() / n.sum() + 0.2
    again = LogBilinear(v).take({k: x[::-1] for k, x in model.rows().items()})
    assert np.allclose(again.scorer().score(code), score)


# --- token counts


def test_counts_are_the_library_s(docs, texts, clashing, empty):
    from tokenizers import Tokenizer

    from strandloom.llm.token_counts import _Counter, count_tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(docs, path).collect())
    want = [(str(i), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False))) for i, t in texts]
    assert got == sorted((*x, x[2] > 512) for x in want)
    assert count_tokens(clashing, path).count() == 15 and count_tokens(empty, path).count() == 0
    rng = random.Random(0)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "!", "1", "<|endoftext|>", " ", "\x1c", "é", "日本", "<|end"]
    odd = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
    with open(path, "rb") as f:
        assert _Counter(".json", f.read()).count(odd) == [len(lib.encode(t, add_special_tokens=False)) for t in odd]


def test_counts_of_a_piece_model(docs, texts):
    import sentencepiece

    from strandloom.llm.token_counts import count_tokens

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in count_tokens(docs, path).collect())
    assert got == sorted((str(i), len(lib.encode(t or ""))) for i, t in texts)

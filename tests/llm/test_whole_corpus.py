"""Corpus operators over whole documents and all rows."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_terms_far_from_an_entity(spark):
    from strandloom.llm.sanitise import find_private

    rng = random.Random(4)
    some = lambda n: " ".join(f"w{chr(97 + rng.randrange(26))}x" for _ in range(n))
    rows = []
    for i in range(200):
        if i % 20 == 0:
            text = f"Mailbox {some(900)} joe{i}@mail.org {some(900)} (mailbox) {some(5)}"
        elif i % 20 == 1:
            text = f"{some(40)} +1 (017) 555-77{i:02d} {some(40)}"
        else:
            text = some(60)
        rows.append((i, text, "en", "s", 0))
    got = {r["id"]: r for r in find_private(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == 200
    for i, text, *_ in rows:
        terms = [text[s["s"] : s["e"]] for s in got[i]["spans"] if s["kind"] == "term"]
        assert terms == (["Mailbox", "mailbox"] if i % 20 == 0 else [])
        starts = [s["s"] for s in got[i]["spans"]]
        assert starts == sorted(starts)


def test_long_texts_teach_and_missing_ones_leave_the_sample_to_others(spark):
    from strandloom.llm.toxicity import fit_toxicity, sample_bags, score_toxicity

    rng = random.Random(9)
    some = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    rows = [(i, f"{some(20)} {'stupidhead ' * 4 if i % 4 == 0 else ''}{'long ' * 400 if i % 8 < 5 and i < 800 else ''}", "", "", 0) for i in range(1000)]
    rows += [(i, None, "", "", 0) for i in range(1000, 1400)]
    labels = [(i, int(i % 4 == 0)) for i in range(3000)]  # no document from 1400 on
    df, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    bags = sample_bags(df, marks, toxic=30, clean=80).collect()
    assert sorted(r["y"] for r in bags) == [0] * 80 + [1] * 30
    assert sum(sum(r["counts"]) > 300 for r in bags) > 30
    model = fit_toxicity(df, marks, toxic=30, clean=80)
    assert score_toxicity(df, model).where("predicted = 1").count() > 0


def test_items_that_share_an_id_or_have_none(spark):
    from strandloom.llm.decontaminate import find_leaks

    item = [" ".join(f"{c}{k}" for k in range(20)) for c in "abcd"]
    bench = spark.createDataFrame([(1, item[0]), (1, item[1]), (None, item[2]), (None, item[3]), (None, item[3])], "item_id long, text string")
    df = spark.createDataFrame([(k, f"before {t} after", "", "", 0) for k, t in enumerate(item)], DOCS)
    for most in (1 << 20, 60):
        got = {r["doc_id"]: (r["contaminated"], [tuple(m) for m in r["_matches"]]) for r in find_leaks(df, bench, most=most).collect()}
        assert got == {k: (True, [(1 if k < 2 else None, 1.0, 1)]) for k in range(4)}

"""The pipeline on a small fixture, held against what each stage must do by brute force."""

import random

import pytest

pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(12)
    item = text(rng, 30)
    block = "\n".join(text(rng, 9) for _ in range(4))
    rows, labels = [], []
    for i in range(400):
        t = "\n".join(text(rng, 12) for _ in range(5))
        if i % 8 == 0:
            t = t.replace(" ", " moronic ", 9)
        rows.append((i, t))
        labels.append((i, 1, int(i % 8 == 0)))
    rows += [(1001, f"{text(rng, 20)}\n{block}\n{text(rng, 20)}"), (1002, f"{text(rng, 20)}\n{block}\n{text(rng, 20)}")]
    base = text(rng, 150)
    rows += [(2001, base), (2002, base + " more"), (2003, base.upper())]
    rows += [(3001, f"{text(rng, 30)} {item} {text(rng, 30)}"), (4001, None), (4002, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, dict(rows), block


def test_stages(spark, folder):
    import corpus_pipeline as cp

    d, rows, block = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, d)
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns
        kept = out.collect()
        seen.append({r["doc_id"]: r for r in kept})
        assert len(seen[-1]) == len(kept)
        docs = spark.createDataFrame(kept, out.schema)
    toxic, lines, copies, leaks, pieces = seen
    dropped = rows.keys() - toxic.keys()
    bad = {i for i in range(0, 400, 8)}
    assert len(dropped & bad) > 0.9 * len(bad) and len(dropped - bad) < 8
    assert lines.keys() == toxic.keys()
    assert block in lines[1001]["text"] and block.split("\n")[1] not in lines[1002]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values() if r["text"] is not None)
    assert lines.keys() - copies.keys() == {2002, 2003}
    assert copies.keys() - leaks.keys() == {3001}
    assert pieces.keys() == leaks.keys() and all(r["round_trip"] for r in pieces.values())
    whole = {r["doc_id"]: r["token_ids"] for r in cp.run(spark, d).collect()}
    assert whole == {i: r["token_ids"] for i, r in pieces.items()}


def test_no_documents(spark, folder, tmp_path):
    import corpus_pipeline as cp

    d = folder[0]
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name_repeated_rows_and_long_texts(spark, folder):
    import corpus_pipeline as cp
    from pyspark.sql import functions as F

    d, rows, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id > 390")
    long = spark.createDataFrame([(5001, " ".join(f"z{k % 7919}" for k in range(40_000)), "en", "s", 0), (5002, None, "en", "s", 0), (None, "no id at all", "en", "s", 0)], DOCS)
    docs = docs.unionByName(long).unionByName(long)
    for c in ("_row", "_k", "_key", "score", "predicted", "held_out", "n_lines", "_matches", "contaminated", "token_ids", "a.b"):
        docs = docs.withColumn(c, F.lit("mine"))
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert all(r["score"] == r["a.b"] == "mine" for r in kept)
        times = sum(r["doc_id"] == 5001 for r in kept)
        assert times == (1 if name == "n-gram Jaccard join" else 2), name  # rows equal in id and text are copies
        assert sum(r["doc_id"] == 5002 for r in kept) == 2 and any(r["doc_id"] is None for r in kept)
        assert before - {r["doc_id"] for r in kept} <= {392, 2002, 2003, 3001}
    assert cp.encode(spark, docs, d).where("not round_trip").count() == 0

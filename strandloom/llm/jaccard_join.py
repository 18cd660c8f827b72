"""N-gram Jaccard join: MinHash banding, shuffled on band hashes, verified on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import arrow_rows, as_text, by_bytes, drop_stash, join_hot, row_key, stash, trim
from strandloom.llm.components import components
from strandloom.llm.shingles import mix, shingle_sets

#: Distinct sets that are compared in one task, on either side, at most, and their shingles, about.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
#: Pairs of sets that are counted in one step of _links.
STEP = 1 << 20


def choose_bands(threshold: float, recall: float = 0.9999, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest chance candidates, with which a pair at the threshold meets in some band with probability `recall`, in `most` hashes."""
    for rows in range(16, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    return most, 1


def _band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(texts, bands) of 64-bit band hashes, for sets that aren't empty."""
    rng = np.random.default_rng(20240229)
    mult = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(sets), b + 1, dtype=np.uint64)
            for r in range(b * rows, (b + 1) * rows):
                h = mix(h + np.minimum.reduceat((flat * mult[r] + add[r]) >> np.uint64(24), starts))
            out[:, b] = h
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """_k, id, set_id (16 bytes of a digest of the shingle set, null for none), size (its shingles), bands."""

    def sign(cols: dict[str, list]) -> dict[str, list]:
        sets = shingle_sets(cols["t"], n)
        full = [s for s in sets if len(s)]
        hashed = iter(_band_hashes(full, bands, rows).view(np.int64)) if full else iter(())
        return {
            "_k": cols["_k"],
            "id": cols["id"],
            "set_id": [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets],
            "size": [len(s) for s in sets],
            "bands": [next(hashed) if len(s) else None for s in sets],
        }

    kept = docs.select(row_key(id_col, text_col).alias("_k"), F.col(id_col).cast("long").alias("id"), as_text(text_col).alias("t"))
    return arrow_rows(kept, sign, "_k binary, id long, set_id binary, size long, bands array<long>")


def _links(sets: list[np.ndarray], left: int, t: Fraction) -> np.ndarray:
    """Boolean matrix of the links among sets[:left], or between sets[:left] and sets[left:] where there are any of these."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    keep = counts[inverse] > 1
    order = np.argsort(inverse[keep], kind="stable")
    row, column = owner[keep][order], inverse[keep][order]
    n, two = len(sets), left < len(sets)
    a, b = (left, n - left) if two else (n, n)
    common = np.zeros((a, b), dtype=np.float32)  # counts below 2**24 are exact
    if len(row):
        # shingles that stand in the same sets count together: columns are told apart by a sum of the sets' random numbers
        starts = np.flatnonzero(np.concatenate([[True], np.diff(column) > 0]))
        degree = np.diff(np.concatenate([starts, [len(row)]]))
        with np.errstate(over="ignore"):
            pattern = np.add.reduceat(mix(np.arange(1, n + 1, dtype=np.uint64))[row], starts)
        _, first, weight = np.unique(np.stack([pattern, degree.astype(np.uint64)]), axis=1, return_index=True, return_counts=True)
        dense = degree[first] > max(8, n // 64)
        for d in np.unique(degree[first[~dense]]).tolist():  # few sets: their pairs are counted one by one
            every = np.flatnonzero(~dense & (degree[first] == d))
            step = max(1, STEP // (d * d))
            for some in (every[at : at + step] for at in range(0, len(every), step)):
                members = row[starts[first[some]][:, None] + np.arange(d)]
                x, y = np.repeat(members, d, axis=1).reshape(-1), np.tile(members, (1, d)).reshape(-1)
                w = np.repeat(weight[some], d * d)
                if two:
                    cross = (x < left) & (y >= left)
                    x, y, w = x[cross], y[cross] - left, w[cross]
                common += np.bincount(x * b + y, w, a * b).reshape(a, b).astype(np.float32)
        width = max(64, min(4096, int(16e6 // (4 * n))))
        many = first[dense]
        for at in range(0, len(many), width):
            cols = many[at : at + width]
            part = np.zeros((n, len(cols)), dtype=np.float32)
            for k, c in enumerate(cols.tolist()):
                part[row[starts[c] : starts[c] + degree[c]], k] = 1
            w = weight[dense][at : at + width].astype(np.float32)
            common += (part[:left] * w) @ (part[left:] if two else part).T
    size = np.array([len(s) for s in sets], dtype=np.int64)
    both = common.astype(np.int64)
    union = size[:left, None] + (size[left:] if two else size)[None, :] - both
    found = both * t.denominator >= union * t.numerator
    if not two:
        np.fill_diagonal(found, False)
    return found


def _roots(found: np.ndarray, two: bool) -> np.ndarray:
    """For each row of the block (and then each column, if two) the number of the first member of its component there."""
    if two:
        a, b = found.shape
        whole = np.zeros((a + b, a + b), dtype=bool)
        whole[:a, a:] = found
        whole[a:, :a] = found.T
        found = whole
    root = np.arange(len(found))
    i, j = np.nonzero(found)
    while len(i):
        low = root.copy()
        np.minimum.at(low, i, root[j])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return root


def _apart(found: np.ndarray, held: list[tuple], left: int) -> np.ndarray:
    """found without the pairs that an earlier band brings together too: each pair of a cluster that is worked through by bands counts in its first common band."""
    bands = np.array([r[8] for r in held], dtype=np.int64)
    one, other = bands[:left], bands[left:] if left < len(held) else bands
    for k in range(held[0][7]):
        found &= one[:, k, None] != other[None, :, k]
    return found


def _verify(batches: Iterator[pa.RecordBatch], t: Fraction, n: int) -> Iterator[pa.RecordBatch]:
    """Groups of rows (g, i, j, b, set_id, copies, t, band, bands) that stand together; for each row its links in the group and the first set it's connected with."""
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        i, j = held[0][1:3]
        held.sort(key=lambda r: (r[3], r[4]))
        left = sum(r[3] == i for r in held)
        two = i != j
        if two and left in (0, len(held)):
            return
        sets = shingle_sets([r[6] for r in held], n)
        found = _links(sets, left if two else len(held), t)
        if held[0][7] is not None:
            found = _apart(found, held, left if two else len(held))
        copies = np.array([r[5] for r in held], dtype=np.int64)
        links = np.concatenate([found @ copies[left:], found.T @ copies[:left]]) if two else found @ copies
        root = _roots(found, two)
        some = [k for k in range(len(held)) if links[k]]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([held[k][4] for k in some], pa.binary()), pa.array(links[some], pa.int64()), pa.array([held[root[k]][4] for k in some], pa.binary())], names=["set_id", "links", "root"])

    key = None
    for batch in batches:
        for part in by_bytes(batch):
            for row in zip(*(part.column(c).to_pylist() for c in range(part.num_columns))):
                if row[:3] != key:
                    yield from flush()
                    held.clear()
                    key = row[:3]
                held.append(row)
    yield from flush()
    held.clear()
    trim()


def _blocks(members: F.Column, shingles: F.Column) -> F.Column:
    return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _sparse(large: DataFrame) -> DataFrame:
    """(g, sparse): of the cut clusters (g, set_id, bands, members) those that have fewer pairs within common bands than pairs in all."""
    each = large.select("g", "members", F.explode("bands").alias("h"))
    groups = each.groupBy("g", "h").agg(F.count(F.lit(1)).alias("c"), F.max("members").alias("members"))
    return groups.groupBy("g").agg(F.sum(F.col("c") * F.col("c")).alias("pairs"), F.max("members").alias("members")).where(F.col("pairs") < F.col("members") * F.col("members")).select("g", F.lit(True).alias("sparse"))


def _by_bands(sets: DataFrame) -> DataFrame:
    """A row for each band that a set (g, set_id, _k, copies, size, bands) shares within its cluster, the band's number with it: key, nb as of a cluster."""
    name = F.unhex(F.md5(F.concat("g", F.encode(F.col("h").cast("string"), "utf-8"))))
    each = sets.select("g", "set_id", "_k", "copies", "size", "bands", F.posexplode("bands").alias("band", "h")).withColumn("key", name)
    groups = each.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("s")).where("_n > 1").select("key", "_n", _blocks(F.col("_n"), F.col("s")).alias("nb"))
    return join_hot(each, groups, "key", each.count()).select("_k", "set_id", "copies", "key", "nb", "band", "bands")


def jaccard_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: _k (row key), id, class_id, n_links, root (the class's own key, null without words).

    Two texts are linked if the Jaccard coefficient of their sets of n-word shingles is at least `threshold`. class_id is
    the smallest id among the documents a document is connected with by links, its own if there are none; n_links counts
    the other documents whose text is linked with its own, copies included.

    1. Every text is signed; texts with the same set are one from here on.
    2. Band hashes are shuffled; a band's smallest set stands for it (a minimum, combined before the shuffle), so a band
       of many sets gives as many edges as it has sets. The components of these edges are the candidates' clusters.
    3. Each set goes once to its cluster. A cluster of more than BLOCK sets, or of more than BLOCK_SHINGLES shingles, is
       cut into blocks, and every two of its blocks meet in a task; there all pairs are compared on their full sets by a
       matrix product, and what leaves the task is a count and a root for each set, no pairs. So every link is counted,
       and none is lost to a choice of representatives. Chance collisions may chain many small groups to one large
       cluster: where a cut cluster has fewer pairs with a common band than pairs, its sets meet band by band instead,
       each pair counting in its first common band.
    4. Roots of cut clusters are joined to components; the others are final.

    Null texts count as empty. Texts without words are linked with nothing, texts of fewer than n words with equal ones.
    Null ids are the smallest; a class without any other id has class_id null. Rows equal in id and text are copies of
    each other. Other columns aren't looked at. An empty table gives an empty one.
    """
    bands, rows = choose_bands(threshold, recall)
    exact = Fraction(str(threshold))
    signed = stash(signatures(docs, n, bands, rows, id_col, text_col))
    classes = stash(signed.where("set_id is not null").groupBy("set_id").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.min("_k").alias("_k"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    entries = classes.select("set_id", F.explode("bands").alias("h"))
    stands = entries.groupBy("h").agg(F.min("set_id").alias("v"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    edges = join_hot(entries, stands, "h", bands * classes.count()).where("set_id <> v").select(F.col("set_id").alias("u"), "v")
    clusters = components(edges).select(F.col("node").alias("set_id"), F.col("root").alias("g"))

    held = stash(clusters.join(classes.drop("least"), "set_id"))
    sizes = held.groupBy("g").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("shingles")).withColumn("members", F.col("_n")).withColumn("nb", _blocks(F.col("_n"), F.col("shingles")))
    n_held = held.count()
    members = join_hot(held, sizes, "g", n_held)
    cut = members.where("nb > 1")
    any_cut = bool(cut.limit(1).count())
    if any_cut:
        cut = stash(cut)
        members = join_hot(held, sizes.join(stash(_sparse(cut)), "g", "left"), "g", n_held)
    whole = members.where("sparse is null") if any_cut else members
    one = whole.select("_k", "set_id", "copies", F.col("g").alias("key"), "nb", F.lit(None).cast("int").alias("band"), F.lit(None).cast("array<long>").alias("bands"))
    if any_cut:
        one = one.unionByName(_by_bands(members.where("sparse")))
    # every pair of blocks of a cluster; a cluster of one block has the pair (0, 0)
    one = one.withColumn("b", F.pmod(F.xxhash64("set_id"), F.col("nb")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least(o, F.col("b")).alias("i"), F.greatest(o, F.col("b")).alias("j")))
    texts = docs.select(row_key(id_col, text_col).alias("_k"), as_text(text_col).alias("t"))
    texts = texts.join(held.select("_k"), "_k", "left_semi").dropDuplicates(["_k"])  # rows equal in id and text share a key
    placed = one.join(texts, "_k").select("key", F.explode(pairs).alias("p"), "b", "set_id", "copies", "t", "band", "bands").select("key", "p.i", "p.j", "b", "set_id", "copies", "t", "band", "bands")
    placed = placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "set_id")
    found = stash(placed.mapInArrow(lambda it: _verify(it, exact, n), "set_id binary, links long, root binary"))

    if any_cut:
        split = found.join(cut.select("set_id"), "set_id", "left_semi")
        joined = components(split.select(F.col("set_id").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("set_id"), F.col("root").alias("r2"))
        found = found.join(joined, "set_id", "left").select("set_id", "links", F.coalesce("r2", "root").alias("root"))
    of_set = found.groupBy("set_id").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    all_sets = stash(classes.join(of_set, "set_id", "left").select("set_id", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "set_id").alias("root")))
    least = all_sets.groupBy("root").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("_n"))
    told = join_hot(all_sets, least, "root", all_sets.count()).select("set_id", "root", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("_n"))
    out = ["_k", "id", F.when(F.col("set_id").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "root"]
    for done in (held, classes):
        drop_stash(done)
    return _spread(signed.select("_k", "id", "set_id"), told).select(*out)


def _spread(signed: DataFrame, told: DataFrame) -> DataFrame:
    """signed with what is told of its set, also where set_id is null; a text that very many documents share stays where its documents are."""
    full = signed.where("set_id is not null")
    none = signed.where("set_id is null")
    for c in ("root", "class_id", "n_links"):
        none = none.withColumn(c, F.lit(None).cast(told.schema[c].dataType))
    return join_hot(full, told, "set_id", signed.count()).unionByName(none)


def keep_one(docs: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class of the join: the one with the smallest id, of equal ids the one with the smallest row key.

    Texts without words are no copies of each other and all stay; rows equal in id and text are, and one stays.
    """
    linked = stash(jaccard_join(docs, threshold, n, id_col=id_col, text_col=text_col).where("n_links > 0").select("_k", "id", "root"))
    first = linked.groupBy("root").agg(F.min(F.struct("id", "_k")).alias("f")).select(F.col("f._k").alias("_k"))
    go = linked.select("_k").distinct().join(first, "_k", "left_anti").withColumnRenamed("_k", "_key")
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), row_key(id_col, text_col).alias("_key")).join(go, "_key", "left_anti")
    twice = linked.groupBy("_k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("_k").alias("_key"))
    if twice.limit(1).count():
        once = kept.join(twice, "_key", "left_semi").groupBy("_key").agg(F.first("_row").alias("_row")).select("_row", "_key")
        kept = kept.join(twice, "_key", "left_anti").unionByName(once)
    return kept.select(*(F.col("_row")[c].alias(c) for c in docs.columns))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-/:-@\[-^`{-\x7f]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT i, j FROM c JOIN n x ON i = x.doc_id JOIN n y ON j = y.doc_id WHERE 5 * k >= 4 * (x.n + y.n - k)),
t(i, j) AS (SELECT i, j FROM l UNION SELECT t.i, l.j FROM t JOIN l ON t.j = l.i)
SELECT doc_id, least(doc_id, coalesce(m, doc_id)) AS class_id, coalesce(k, 0) AS n_links FROM documents
LEFT JOIN (SELECT i AS doc_id, min(j) AS m FROM t GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT i AS doc_id, count(*) AS k FROM l GROUP BY 1) USING (doc_id)
"""

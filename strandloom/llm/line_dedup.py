"""Line dedup over overlapping three-line windows, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import as_text, row_key

LINES = 3


def _windows(rows: DataFrame, lines: int) -> DataFrame:
    """A row for each window of consecutive lines: 128 bits of hash, from line hashes under two seeds, and the place of its first line."""
    one = rows.select("_k", "_id", F.split(as_text("_t"), "\n", -1).alias("l")).where(F.size("l") >= lines)
    one = one.select("_k", "_id", F.transform("l", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))).alias("l"))
    at = F.transform(
        F.sequence(F.lit(0), F.size("l") - lines),
        lambda i: F.struct(
            i.alias("p"),
            F.xxhash64(*(F.get("l", i + j)["a"] for j in range(lines))).alias("a"),
            F.xxhash64(*(F.get("l", i + j)["b"] for j in range(lines))).alias("b"),
        ),
    )
    return one.select("_k", "_id", F.explode(at).alias("w")).select("_k", "_id", "w.p", "w.a", "w.b")


def repeated_spans(docs: DataFrame, lines: int = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines that later occurrences of a window cover: _k (row key) and spans, an ordered array of (s, e), both inclusive.

    The first occurrence of a window is the one with the smallest (id, row key, line). Counts are combined before they
    are shuffled, so a window that a third of all documents holds is one row from each task; the join that finds its
    later occurrences has a side that Spark splits where it is skewed.
    """
    rows = docs.select(row_key(id_col, text_col).alias("_k"), F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    first = (
        _windows(rows, lines)
        .groupBy("a", "b")
        .agg(F.min(F.struct("_id", "_k", "p")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("a", "b", F.col("first._k").alias("fk"), F.col("first.p").alias("fp"))
    )
    later = _windows(rows, lines).join(first, ["a", "b"]).where((F.col("_k") != F.col("fk")) | (F.col("p") != F.col("fp"))).groupBy("_k", "p").agg(F.lit(1).alias("one"))
    order = Window.partitionBy("_k").orderBy("p")
    fresh = F.when(F.col("p") > F.lag("p").over(order) + lines, 1).otherwise(0)  # else it overlaps or touches the one before
    merged = later.select("_k", "p", fresh.alias("f")).select("_k", "p", F.sum("f").over(order).alias("g")).groupBy("_k", "g").agg(F.min("p").alias("s"), (F.max("p") + lines - 1).alias("e"))
    return merged.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))


def dedup_lines(docs: DataFrame, lines: int = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines gone that a later occurrence of some window of `lines` consecutive lines covers.

    Lines are what newline characters part; they are compared as they stand. Windows overlap, and repeat within a
    document as well as between documents; what the later occurrences cover is merged, and a document may lose all its
    lines and stay with an empty text. Texts of fewer lines have no window. Null texts stay null, empty ones empty.
    Rows equal in id and text count as one row, and each of them keeps what that one keeps; null ids come first in order.
    All columns stay; n_lines and n_removed (int) are added, and take the place of columns of these names.
    """
    spans = repeated_spans(docs, lines, id_col, text_col)
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), row_key(id_col, text_col).alias("_k"))
    joined = held.join(spans, "_k", "left").select("_row", F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")).alias("_v"), F.split(F.col("_row")[text_col], "\n", -1).alias("_l"))
    n = F.size("_v")
    parts = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.slice(
            F.col("_l"),
            F.when(i == 0, 1).otherwise(F.get("_v", i - 1)["e"] + 2),
            F.coalesce(F.get("_v", i)["s"], F.size("_l")) - F.when(i == 0, 0).otherwise(F.get("_v", i - 1)["e"] + 1),
        ),
    )
    text = F.when(n == 0, F.col("_row")[text_col]).otherwise(F.array_join(F.flatten(parts), "\n"))
    gone = F.aggregate("_v", F.lit(0), lambda a, v: a + v["e"] - v["s"] + 1)
    kept = [text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return joined.select(*kept, F.coalesce(F.when(F.col("_l").isNull(), 0).otherwise(F.size("_l")), F.lit(0)).alias("n_lines"), gone.alias("n_removed"))


SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, p, l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2] AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM d)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p + unnest([0, 1, 2]) AS i FROM later),
lines AS (SELECT doc_id, l[i] AS line, i FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM lines ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(kept.text, '') AS text, len(l)::INT AS n_lines, (len(l) - coalesce(n, 0))::INT AS n_removed FROM d LEFT JOIN kept USING (doc_id)
"""

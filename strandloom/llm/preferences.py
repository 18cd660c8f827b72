"""Preference formatting: the common turns of two conversations once as prompt, the rest as paired completions with masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns: array of (role, text)), a row for each conversation, in order of turn, then role, then text.

    Null roles are users, null texts empty; turns without a conversation's id belong to none. Repeated rows are turns each.
    """
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("n"), F.coalesce(role_col, F.lit("user")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).alias("t")
    )
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def last_answer(turns: Column) -> Column:
    """Place, from 1, of the last turn of the assistant; 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(0))), F.lit(0))


def swapped_pairs(convs: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): each conversation, and itself with its last answer swapped for that of the conversation with the next id.

    Where no such answer is, the rejected one ends before the last answer; without any answer both are the same.
    """
    at = last_answer(F.col("turns"))
    other = convs.select((F.col("conv_id") - 1).alias("conv_id"), F.get("turns", at - 1)["text"].alias("alt"))
    rows = convs.withColumn("at", at).join(other, "conv_id", "left")
    before = F.slice("turns", 1, F.greatest(F.col("at") - 1, F.lit(0)))
    swapped = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(i == F.col("at") - 1, F.col("alt")).otherwise(t["text"]).alias("text")))
    rejected = F.when(F.col("at") == 0, F.col("turns")).when(F.col("alt").isNull(), before).otherwise(swapped)
    return rows.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))


def _common(a: str, b: str) -> Column:
    """Number of turns from the start that agree in role and text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def _safe(text: Column) -> Column:
    """No text can write a marker: its opening is parted."""
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def _turn(t: Column) -> Column:
    return F.concat(F.lit(OPEN), _safe(t["role"]), F.lit("\n"), _safe(t["text"]), F.lit(CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def _mask(turns: Column) -> Column:
    """Places (s, e) in the rendered turns, code points, the end exclusive, of the assistant's texts with their closing marks: what is learned from."""
    state = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(_turn(t))).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(acc["out"], F.array(F.struct((acc["at"] + len(OPEN) + F.length(_safe(t["role"])) + 1).cast("int").alias("s"), (acc["at"] + F.length(_turn(t))).cast("int").alias("e")))),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
    )
    return state["out"]


def format_preferences(pairs: DataFrame) -> DataFrame:
    """(pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask) for each row of pairs (pair_id, chosen, rejected: arrays of (role, text)).

    The longest common prefix of turns is rendered once as prompt; what follows on either side is a completion, with the
    places of the assistant's words as its mask, everything else being masked out. Sides that are equal give two empty
    completions, sides without a common turn an empty prompt. Null sides count as empty; null ids pass through. A
    conversation is one row here, as it is one row of the result; the work on it is within the row.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    rows = pairs.select("pair_id", F.coalesce("chosen", none).alias("a"), F.coalesce("rejected", none).alias("b"))
    rows = rows.withColumn("n_common", _common("a", "b"))
    rest = {s: F.slice(s, F.col("n_common") + 1, F.greatest(F.size(s) - F.col("n_common"), F.lit(0))) for s in ("a", "b")}
    rows = rows.select("pair_id", "n_common", F.slice("a", 1, F.col("n_common")).alias("p"), rest["a"].alias("a"), rest["b"].alias("b"))
    return rows.select("pair_id", "n_common", _render(F.col("p")).alias("prompt"), _render(F.col("a")).alias("chosen"), _render(F.col("b")).alias("rejected"), _mask(F.col("a")).alias("chosen_mask"), _mask(F.col("b")).alias("rejected_mask"))


SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, 'user'), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, coalesce(max(i) FILTER (WHERE role = 'assistant'), 0) AS ans FROM t GROUP BY 1),
alt AS (SELECT t.conv_id - 1 AS conv_id, text AS alt FROM t JOIN l ON t.conv_id = l.conv_id AND i = ans),
two AS (SELECT t.conv_id, role, text, i, CASE WHEN i = ans THEN alt WHEN ans > 0 AND alt IS NULL AND i > ans THEN NULL ELSE text END AS other
  FROM t JOIN l USING (conv_id) LEFT JOIN alt USING (conv_id)),
n AS (SELECT conv_id, (coalesce(min(i) FILTER (WHERE text IS DISTINCT FROM other), count(*) + 1) - 1)::INT AS n_common FROM two GROUP BY 1),
r AS (SELECT conv_id, i, n_common, role, '<|im_start|>' || replace(role, '<|', '<\|') || chr(10) AS head,
  replace(text, '<|', '<\|') || '<|im_end|>' || chr(10) AS a, replace(other, '<|', '<\|') || '<|im_end|>' || chr(10) AS b FROM two JOIN n USING (conv_id)),
p AS (SELECT *, sum(CASE WHEN i > n_common THEN length(head || a) END) OVER w AS ea, sum(CASE WHEN i > n_common THEN length(head || b) END) OVER w AS eb FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i))
SELECT conv_id AS pair_id, n_common, coalesce(string_agg(head || a, '' ORDER BY i) FILTER (WHERE i <= n_common), '') AS prompt,
  coalesce(string_agg(head || a, '' ORDER BY i) FILTER (WHERE i > n_common), '') AS chosen,
  coalesce(string_agg(head || b, '' ORDER BY i) FILTER (WHERE i > n_common), '') AS rejected,
  coalesce(string_agg((ea - length(a))::BIGINT || ':' || ea::BIGINT, ',' ORDER BY i) FILTER (WHERE i > n_common AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((eb - length(b))::BIGINT || ':' || eb::BIGINT, ',' ORDER BY i) FILTER (WHERE i > n_common AND role = 'assistant' AND b IS NOT NULL), '') AS rejected_mask
FROM p GROUP BY conv_id, n_common
"""

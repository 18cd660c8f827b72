"""CIGAR strings: arrays of (n, op) and their text, in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = "MIDNSHP=X"
_ELEMENT = "struct<n:int,op:string>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coalesce_ops(ops: Column | str) -> Column:
    """Array of (n, op) with empty elements gone and equal neighbours merged."""
    none = F.array().cast(f"array<{_ELEMENT}>")

    def push(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        merged = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct((last["n"] + x["n"]).cast("int").alias("n"), x["op"].alias("op"))))
        fresh = F.concat(acc, F.array(F.struct(x["n"].cast("int").alias("n"), x["op"].alias("op"))))
        return F.when(x["n"] == 0, acc).when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["op"] == x["op"]), merged).otherwise(fresh)

    return F.aggregate(_col(ops), none, push)


def compress(chars: Column | str) -> Column:
    """Array of (n, op) from a string with one letter for each column: its runs, found in one pass."""
    runs = F.regexp_extract_all(_col(chars), F.lit(r"(?s)((.)\2*)"), F.lit(1))
    return F.transform(runs, lambda r: F.struct(F.length(r).cast("int").alias("n"), F.substring(r, 1, 1).alias("op")))


def to_text(ops: Column | str) -> Column:
    return F.array_join(F.transform(_col(ops), lambda x: F.concat(x["n"].cast("string"), x["op"])), "")


def parse(text: Column | str, strict: bool = True) -> Column:
    """Array of (n, op); null where the text isn't one of counts and ops only. Not strict: an unknown letter counts as M."""
    text = _col(text)
    pattern = r"(\d+)([MIDNSHP=X])" if strict else r"(\d+)(\D)"
    whole = F.regexp_replace(text, pattern, "") == ""  # nothing is left between elements; a repeated group would recurse for each
    n = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    op = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    found = F.zip_with(n, op, lambda a, b: F.struct(a.cast("int").alias("n"), (b if strict else F.when(F.instr(F.lit(OPS), b) > 0, b).otherwise("M")).alias("op")))
    return F.when(whole, found)


def op_code(op: Column | str) -> Column:
    """0-8 for MIDNSHP=X, 0 for others."""
    return F.greatest(F.instr(F.lit(OPS), _col(op)) - 1, F.lit(0))


def consumed(ops: Column | str, letters: str) -> Column:
    """Sum of counts whose op is one of `letters`."""
    return F.aggregate(F.filter(_col(ops), lambda x: F.instr(F.lit(letters), x["op"]) > 0), F.lit(0), lambda a, x: (a + x["n"]).cast("int"))


def query_length(ops: Column | str, clips: bool = False) -> Column:
    return consumed(ops, "MI=XS" if clips else "MI=X")


def reference_length(ops: Column | str) -> Column:
    return consumed(ops, "MDN=X")


def from_hmm_path(states: Column | str) -> Column:
    """State numbers to ops: 0 '=', 1 'I', 2 'D', others 'M'; merged."""
    letter = lambda s: F.when(s == 0, "=").when(s == 1, "I").when(s == 2, "D").otherwise("M")
    return compress(F.array_join(F.transform(_col(states), letter), ""))


def position(ops: Column | str, at: Column | str, letters: str) -> Column:
    """`at` if the ops consume as much on that side (and anything at all), else null."""
    total = consumed(ops, letters)
    some = F.exists(_col(ops), lambda x: F.instr(F.lit(letters), x["op"]) > 0)
    return F.when(some & (total >= _col(at)), _col(at))


def query_position(ops: Column | str, at: Column | str) -> Column:
    return position(ops, at, "MI=XS")


def reference_position(ops: Column | str, at: Column | str) -> Column:
    return position(ops, at, "MDN=X")


def from_aligned(a: Column | str, b: Column | str, left: Column | None = None, right: Column | None = None) -> Column:
    """Ops of two gapped rows: = X I D, with S clips where lengths of clipped ends are given."""
    pair = F.zip_with(F.split(_col(a), ""), F.split(_col(b), ""), lambda x, y: F.when((x == "") & (y == ""), "").when(x == "-", "D").when(y == "-", "I").when(x == y, "=").otherwise("X"))  # two empty rows split into one empty string each
    ops = compress(F.array_join(pair, ""))
    clip = lambda n: F.filter(F.array(F.struct(n.cast("int").alias("n"), F.lit("S").alias("op"))), lambda x: F.coalesce(x["n"], F.lit(0)) > 0)
    zero = F.lit(0)
    return F.concat(clip(left if left is not None else zero), ops, clip(right if right is not None else zero))


def identity(a: Column | str, b: Column | str) -> Column:
    """100 times the equal columns over the columns where a has a residue; 0 if there are none."""
    x, y = F.split(_col(a), ""), F.split(_col(b), "")
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p == q) & (p != "-") & (p != "")), lambda t: t))
    n = F.length(F.replace(_col(a), F.lit("-"), F.lit("")))
    return F.when(n > 0, same * F.lit(100.0) / n).otherwise(F.lit(0.0))


def gap_count(a: Column | str, b: Column | str) -> Column:
    """Columns with a gap in either row."""
    return F.size(F.filter(F.zip_with(F.split(_col(a), ""), F.split(_col(b), ""), lambda p, q: (p == "-") | (q == "-")), lambda t: F.coalesce(t, F.lit(False))))

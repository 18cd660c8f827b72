"""PII: patterns for protected entities, and terms that the corpus shows to disclose them."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import as_text, by_bytes, row_key, stash

KINDS = ("email", "ip", "card", "phone")
#: Share of an entity's information that a term may disclose, and documents in which both must stand.
DISCLOSURE, SUPPORT = 0.6, 5
FLUSH_TERMS = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the leftmost non-overlapping matches of each kind that pass its check, by start, then kind as listed.

    The patterns are those of the contract without their backtracking: an address is sought from its @, and digits are
    never given back, so a long run costs its length.
    """
    out = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, m.end(), 0))
                last = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return [(a, b, KINDS[k]) for a, b, k in out]


def words_outside(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words, of two letters or more, that touch no entity, over the whole text."""
    covered: list[list[int]] = []
    for a, b, _ in spans:  # by start
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(b, covered[-1][1])
        else:
            covered.append([a, b])
    at = 0
    for m in _WORD.finditer(text):
        a, b = m.span()
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        if b - a > 1 and not (at < len(covered) and covered[at][0] < b):
            yield m[0].lower(), a, b


def term_counts(texts: DataFrame) -> DataFrame:
    """(term, df, email, ip, card, phone) over whole texts of column t: documents with the term, and those of them that hold an entity of a kind while the term stands outside of all entities.

    The row of a null term counts documents in all, and those with each kind. Tasks count in a table that they empty when it is full.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str | None] = Counter()
        joint: dict[str | None, list[int]] = {}

        def out() -> pa.RecordBatch:
            none = [0] * len(KINDS)
            terms = list(seen.keys() | joint.keys())
            both = [joint.get(x, none) for x in terms]
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[x] for x in terms], pa.int64()), *(pa.array([b[k] for b in both], pa.int64()) for k in range(len(KINDS)))], names=["term", "df", *KINDS])

        for batch in batches:
            for part in by_bytes(batch):
                for t in part.column(0).to_pylist():
                    seen.update(set(_WORD.findall(t.lower())))
                    seen[None] += 1
                    if spans := base_spans(t):
                        kinds = sorted({KINDS.index(k) for _, _, k in spans})
                        for x in {None, *(w for w, _, _ in words_outside(t, spans))}:
                            row = joint.setdefault(x, [0] * len(KINDS))
                            for k in kinds:
                                row[k] += 1
                    if len(seen) + len(joint) > FLUSH_TERMS:
                        yield out()
                        seen.clear()
                        joint.clear()
        yield out()

    counted = texts.select("t").mapInArrow(count, f"term string, df long, {', '.join(f'{k} long' for k in KINDS)}")
    return counted.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("df", *KINDS)))


def disclosing_terms(texts: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(kind, term, share) of the terms that disclose a kind of entity.

    The information of an entity is -log2 p(kind), of which a term discloses its pointwise mutual information,
    log2 p(kind, term) / (p(kind) p(term)); p are shares of all documents, and the joint one is of documents that hold
    both, however far apart. A share of 1: the term stands in no document without an entity of the kind.
    """
    told = stash(term_counts(texts).where(F.col("term").isNull() | (F.greatest(*KINDS) >= support)))
    sums = told.where("term is null").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("df", *KINDS))).first()
    total = float(max(1, sums["df"]))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("both"), F.lit(float(sums[k])).alias("n")) for k in KINDS)))
    rows = told.where("term is not null").select("term", "df", each.alias("x")).select("term", "df", "x.*").where((F.col("both") >= support) & (F.col("n") < total))
    share = F.log2(F.col("both") * total / (F.col("n") * F.col("df"))) / -F.log2(F.col("n") / total)
    return rows.withColumn("share", share).where(F.col("share") >= disclosure).select("kind", "term", "share")


def find_private(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: _k, id, n_email, n_ip, n_card, n_phone, base_sha256, and spans (array of kind, s, e).

    Entities are found by pattern in every whole text (null: empty). Then the corpus tells which words that stand in a
    document with an entity reveal its kind: co-occurrence over all whole documents, by information (see
    disclosing_terms). Each of those words, wherever it stands in a document with an entity of the kind, is a span of
    kind `term`. spans are ordered by start, then kind as listed, terms last; places are code points, the end exclusive.
    Rows equal in id and text get equal results; null ids stay null. Other columns aren't looked at. The disclosing terms
    are broadcast; texts are read twice and aren't shuffled.
    """
    rows = docs.select(row_key(id_col, text_col).alias("_k"), F.col(id_col).cast("long").alias("id"), as_text(text_col).alias("t"))
    kinds_of: dict[str, set[str]] = {}
    for r in disclosing_terms(rows, disclosure, support).collect():
        kinds_of.setdefault(r["term"], set()).add(r["kind"])
    sent = docs.sparkSession.sparkContext.broadcast(kinds_of)
    span = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = sent.value
        for batch in batches:
            for part in by_bytes(batch):
                texts = part.column(2).to_pylist()
                found = [base_spans(t) for t in texts]
                counts = [Counter(k for _, _, k in f) for f in found]
                digest = [hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in f).encode()).hexdigest() for f in found]
                every = []
                for t, f, c in zip(texts, found, counts):
                    more = [(a, b, "term") for w, a, b in words_outside(t, f) if w in told and not told[w].isdisjoint(c)] if f and told else []
                    every.append([{"kind": k, "s": a, "e": b} for a, b, k in sorted(f + more, key=lambda s: s[0])])
                out = [part.column(0), part.column(1), *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS), pa.array(digest), pa.array(every, span)]
                yield pa.RecordBatch.from_arrays(out, names=["_k", "id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return rows.mapInArrow(scan, "_k binary, id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans array<struct<kind:string,s:int,e:int>>")


def sanitise(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with entities generalised to their kind in brackets and disclosing terms removed, where spans of find_private say so.

    Spans that overlap are merged; the first one's kind stands for them all. All columns stay.
    """
    spans = found.select("_k", "spans").dropDuplicates(["_k"])

    @F.pandas_udf("string")
    def rewrite(texts, all_spans):
        import pandas as pd

        def one(text, spans):
            if text is None or spans is None:
                return text
            out, at = [], 0
            for s in spans:
                if s["s"] >= at:
                    out.append(text[at : s["s"]])
                    out.append("" if s["kind"] == "term" else f"[{s['kind']}]")
                at = max(at, s["e"])
            return "".join(out) + text[at:]

        return pd.Series([one(t, s) for t, s in zip(texts, all_spans)], dtype="object")

    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), row_key(id_col, text_col).alias("_k")).join(spans, "_k", "left")
    text = rewrite(F.col("_row")[text_col], F.col("spans"))
    return held.select(*(text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns))

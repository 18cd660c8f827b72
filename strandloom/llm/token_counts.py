"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from strandloom.llm.common import as_text

#: A space that stands between two white space characters, or after one at the end: the text isn't cut there.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: The place between anything but white space and white space that the vocabulary's pattern knows as such.
_SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])")
#: Entries kept for each worker, and bytes handed to the library at once.
MEMO_ENTRIES, BATCH_BYTES = 400_000, 1 << 20
_counters: dict[str, "_Counter"] = {}


def _batches(pieces: list[str], most: int = BATCH_BYTES):
    """Lists of pieces of about equal bytes: longest first, so that none is held up by one long text."""
    pieces = sorted(pieces, key=len, reverse=True)
    batch, size = [], 0
    for p in pieces:
        if batch and size + 4 * len(p) + 16 > most:
            yield batch
            batch, size = [], 0
        batch.append(p)
        size += 4 * len(p) + 16
    if batch:
        yield batch


class _Counter:
    """Counts tokens with one library object; pieces between safe boundaries are encoded once while they stay in the memo."""

    def __init__(self, kind: str, blob: bytes) -> None:
        self.kind = kind
        self.memo: dict[str, int] = {}
        if kind == ".json":
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_str(blob.decode())
            self.lib.no_truncation()
            self.lib.no_padding()
        else:
            import sentencepiece

            self.lib = sentencepiece.SentencePieceProcessor(model_proto=blob)

    def _lengths(self, pieces: list[str]) -> list[int]:
        if self.kind == ".json":
            return [len(e) for e in self.lib.encode_batch_fast(pieces, add_special_tokens=False)]
        return [len(e) for e in self.lib.encode(pieces, num_threads=1)]

    @staticmethod
    def cut(text: str) -> list[str]:
        """Pieces that encode as they do within the text: cut before a white space character that follows another kind."""
        if _UNSAFE.search(text) is None:
            head, *rest = text.split(" ")
            return [head, *(" " + p for p in rest)]
        return _SAFE.split(text)

    def count(self, texts: list[str]) -> list[int]:
        if self.kind != ".json":
            out = [0] * len(texts)
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            for at in range(0, len(order), 64):
                part = order[at : at + 64]
                for i, n in zip(part, self._lengths([texts[i] for i in part])):
                    out[i] = n
            return out
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        memo, out = self.memo, []
        for at in range(0, len(texts), 256):
            cut = [self.cut(t) for t in texts[at : at + 256]]
            new = set().union(*cut) - memo.keys()
            for batch in _batches(list(new)):
                memo.update(zip(batch, self._lengths(batch)))
            get = memo.__getitem__
            out.extend(sum(map(get, pieces)) for pieces in cut)
        return out


def _counter(kind: str, blob: bytes) -> _Counter:
    key = kind + hashlib.md5(blob).hexdigest()
    if key not in _counters:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _counters[key] = _Counter(kind, blob)
    return _counters[key]


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text, as the vocabulary file's own library gives them.

    tokenizer_file: a .json file of tokenizers or a .model file of sentencepiece, read by the driver and sent to the
    executors (a few MB). Texts are cut where the pattern of a byte-level vocabulary always cuts, and no piece is
    encoded twice while a worker remembers it; a piece may still be a whole long text. No token is added.
    Null texts count as empty: 0 bytes, 0 tokens. Null, repeated ids and repeated rows pass through; other columns,
    whatever their names, are not looked at. An empty table gives an empty one.

    Returns id_col, n_bytes, n_tokens (long), over_limit (n_tokens > limit).
    """
    kind, blob = Path(tokenizer_file).suffix, Path(tokenizer_file).read_bytes()
    if kind not in (".json", ".model"):
        raise ValueError(f"no library for {tokenizer_file}")
    sent = docs.sparkSession.sparkContext.broadcast(blob)

    @F.pandas_udf(LongType())
    def lengths(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array(_counter(kind, sent.value).count(texts.tolist()), dtype="int64"))

    rows = docs.select(F.col(id_col), as_text(text_col).alias("t"))
    rows = rows.select(id_col, F.octet_length("t").cast("long").alias("n_bytes"), lengths("t").alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)

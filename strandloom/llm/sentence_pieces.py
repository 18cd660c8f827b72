"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import as_text, by_bytes, trim

MARK = "▁"
#: Stands for a marker in the text itself; no UTF-8 text holds a lone surrogate.
_LITERAL = "\ud800"
MEMO_WORDS, LONG_WORD = 60_000, 64
UNKNOWN_PENALTY = 10.0


# Where a model file names its kind (field of the trainer's settings, then of the kind), and the kinds.
TRAINER, KIND, UNIGRAM, BPE = 2, 3, 1, 2


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message in wire format; fixed-width values as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = blob[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(blob):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}[tag & 7] if tag & 7 != 2 else number()
        yield tag >> 3, blob[at : at + size]
        at += size


def model_type(blob: bytes) -> int:
    """The kind that a model file states: UNIGRAM, which is also what none stated means, BPE, or another."""
    for field, value in _fields(blob):
        if field == TRAINER:
            return next((v for k, v in _fields(value) if k == KIND), UNIGRAM)
    return UNIGRAM


class Pieces:
    """A vocabulary: pieces with log scores, byte pieces, and the double-array trie over the pieces' characters.

    Of a vocabulary with ranks for scores (0, -1, -2, ...: what a file of merges holds), the log score of rank r is
    -log(r + 2): ranks aren't logarithms, and a piece weighs as its frequency by Zipf's law would.
    """

    def __init__(self, pieces: list[tuple[str, float]], ids: list[int], byte_ids: dict[int, int], unk: int, ranks: bool = False) -> None:
        scores = [-math.log(2 - min(0.0, s)) if ranks else s for _, s in pieces]
        self.byte_ids, self.unk = byte_ids, unk
        chars = sorted({c for p, _ in pieces for c in p})
        self.alphabet = np.zeros(0x110000, dtype=np.int32)
        self.alphabet[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        code = {c: i + 1 for i, c in enumerate(chars)}
        self.unknown_score = min(scores, default=0.0) - UNKNOWN_PENALTY
        self.score = np.array(scores + [self.unknown_score])  # the last one is an unknown character
        self.ids = np.array(ids + [unk], dtype=np.int32)
        self.length = np.array([len(p) for p, _ in pieces] + [1])
        self._build([([code[c] for c in p], k) for k, (p, _) in enumerate(pieces) if p])
        # No piece has a marker after another character: then words between markers are encoded on their own.
        self.by_word = all(MARK not in p.lstrip(MARK) for p, _ in pieces)
        breaks = "" if "\n" in code else "\n"
        self.splitter = re.compile(f"{MARK}+[^{MARK}{breaks}]*|[^{MARK}{breaks}]+|{breaks or MARK}")

    def _build(self, keys: list[tuple[list[int], int]]) -> None:
        """base and check by first fit: a node's children stand at base[node] + character, and name it in check."""
        root: dict = {}
        for key, value in keys:
            node = root
            for c in key:
                node = node.setdefault(c, {})
            node[0] = value
        size = 1 << 18
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        free_from, used, todo = 1, 1, [(root, 0)]
        while todo:
            node, at = todo.pop()
            value[at] = node.get(0, -1)
            kids = np.array(sorted(c for c in node if c), dtype=np.int64)
            if not len(kids):
                continue
            while check[free_from] >= 0:
                free_from += 1
            first, last = int(kids[0]), int(kids[-1])
            while used + last + 1024 >= len(check):
                base, check, value = (np.concatenate([x, np.full(len(x), fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
            if len(kids) == 1:
                b = free_from - first if free_from > first else None
            else:  # near the first free place, else behind all that is taken
                lo = max(1, free_from - first)
                spots = np.flatnonzero((check[(lo + np.arange(256))[:, None] + kids[None, :]] < 0).all(1))
                b = lo + int(spots[0]) if len(spots) else None
            if b is None:
                b = max(1, used - first)
            base[at] = b
            check[b + kids] = at
            used = max(used, b + last + 1)
            todo.extend((node[int(c)], b + int(c)) for c in kids)
        top = int(np.flatnonzero(check >= 0).max()) + len(self.alphabet[self.alphabet > 0]) + 2
        pad = max(0, top - len(check))
        self.base = np.concatenate([base, np.zeros(pad, np.int32)])[:top]
        self.check = np.concatenate([check, np.full(pad, -1, np.int32)])[:top]
        self.value = np.concatenate([value, np.full(pad, -1, np.int32)])[:top]

    @classmethod
    def from_model(cls, blob: bytes) -> "Pieces":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        n = range(sp.get_piece_size())
        byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in n if sp.is_byte(i)}
        normal = [i for i in n if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        return cls([(sp.id_to_piece(i), sp.get_score(i)) for i in normal], normal, byte_ids, sp.unk_id(), model_type(blob) == BPE)

    def piece_bytes(self, names: dict[int, str]) -> list[bytes]:
        out = [b""] * (max([*names, *self.byte_ids.values(), self.unk]) + 1)
        for i, p in names.items():
            out[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte_ids.items():
            out[i] = bytes([b])
        out[self.unk] = " ⁇ ".encode()
        return out

    def edges(self, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every piece that stands in the buffer within its word, and of the unknown characters; the trie is walked from all places at once."""
        chars = self.alphabet[buf]
        place = np.arange(len(buf))
        start, node, depth, at, what = place, np.zeros(len(buf), np.int64), 0, [], []
        single = np.zeros(len(buf), dtype=bool)
        while len(start):
            inside = start + depth < ends[start]
            start, node = start[inside], node[inside]
            c = chars[start + depth]
            to = self.base[node] + c
            ok = (c > 0) & (self.check[to] == node)
            start, node = start[ok], to[ok]
            depth += 1
            whole = self.value[node] >= 0
            at.append(start[whole])
            what.append(self.value[node[whole]])
            if depth == 1:
                single[start[whole]] = True
        at.append(np.flatnonzero(~single))
        what.append(np.full(len(at[-1]), len(self.score) - 1))
        return np.concatenate(at), np.concatenate(what)

    def viterbi(self, words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Token ids and score of the best segmentation of each word; of equal scores the one whose last piece is longest."""
        if not words:
            return [], np.empty(0)
        buf = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        whole = np.array([len(w) for w in words], dtype=np.int64)
        at, what = self.edges(buf, np.repeat(np.cumsum(whole), whole))
        sizes, of_word = self._parts(whole, at, what)
        stops = np.cumsum(sizes)
        starts = stops - sizes
        # nodes are characters' starts, with a further one for each word's end
        parts = len(sizes)
        word = np.repeat(np.arange(parts), sizes)[at]
        u = at + word
        v = u + self.length[what]
        local = v - (starts[word] + word)
        best, back = np.full(len(buf) + parts, -np.inf), np.zeros(len(buf) + parts, dtype=np.int64)
        best[starts + np.arange(parts)] = 0
        order = np.lexsort((u, v, local))
        u, v, what, local = u[order], v[order], what[order], local[order]
        score = self.score[what]
        short = sizes[word[order]] <= LONG_WORD
        for j, (lo, hi) in _steps(local, short):
            sel = slice(lo, hi) if short[lo:hi].all() else lo + np.flatnonzero(short[lo:hi])
            uu, vv = u[sel], v[sel]
            cand = best[uu] + score[sel]
            first = np.concatenate([[0], np.flatnonzero(np.diff(vv)) + 1])
            top = np.maximum.reduceat(cand, first)
            is_top = cand == np.repeat(top, np.diff(np.concatenate([first, [len(vv)]])))
            pick = np.flatnonzero(is_top)
            node, keep = np.unique(vv[pick], return_index=True)
            best[node], back[node] = top, what[sel][pick[keep]]
        long = np.flatnonzero(~short)
        for a, b, k, s in zip(u[long].tolist(), v[long].tolist(), what[long].tolist(), score[long].tolist()):
            if best[a] + s > best[b]:
                best[b], back[b] = best[a] + s, k
        cur = stops + np.arange(parts)
        scores = np.bincount(of_word, best[cur], len(words))
        begin = starts + np.arange(parts)
        who, ids, nodes, active = [], [], [], np.arange(parts)
        while len(active := active[cur[active] > begin[active]]):
            k = back[cur[active]]
            cur[active] -= self.length[k]
            who.append(active)
            ids.append(k)
            nodes.append(cur[active] - active)  # back to places in the buffer
        if not who:
            return [np.empty(0, np.int32) for _ in words], scores
        who, ids, nodes = np.concatenate(who), np.concatenate(ids), np.concatenate(nodes)
        order = np.argsort(nodes, kind="stable")
        who, ids, nodes = of_word[who[order]], ids[order], nodes[order]
        tokens, unknown = self.ids[ids], ids == len(self.score) - 1
        if unknown.any() and self.byte_ids:
            tokens, who = self._with_bytes(tokens, who, nodes, unknown, buf)
        cuts = np.searchsorted(who, np.arange(1, len(words)))
        return np.split(tokens, cuts), scores

    def _parts(self, sizes: np.ndarray, at: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the parts of words, and the word of each: a word longer than LONG_WORD is cut where no piece reaches across, as every way through it goes through there."""
        cut = np.zeros(int(sizes.sum()) + 1, dtype=bool)
        cut[np.concatenate([[0], np.cumsum(sizes)])] = True
        if (sizes > LONG_WORD).any():
            inner = self.length[what] > 1
            across = np.cumsum(np.bincount(at[inner] + 1, minlength=len(cut)) - np.bincount(at[inner] + self.length[what[inner]], minlength=len(cut)))
            cut[:-1] |= (across[:-1] == 0) & np.repeat(sizes > LONG_WORD, sizes)
        places = np.flatnonzero(cut)
        return np.diff(places), np.searchsorted(np.cumsum(sizes), places[:-1], side="right")

    def _with_bytes(self, tokens: np.ndarray, who: np.ndarray, nodes: np.ndarray, unknown: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each unknown character becomes the byte pieces of its UTF-8."""
        parts = [[self.byte_ids[b] for b in (MARK if chr(buf[n]) == _LITERAL else chr(buf[n])).encode()] for n in nodes[unknown].tolist()]
        sizes = np.ones(len(tokens), dtype=np.int64)
        sizes[unknown] = [len(p) for p in parts]
        out = np.repeat(tokens, sizes)
        out[np.repeat(unknown, sizes)] = [i for p in parts for i in p]
        return out, np.repeat(who, sizes)

    def words(self, text: str) -> list[str]:
        """A marker, then the text with markers for spaces, cut where no piece can reach across."""
        if not text:
            return []
        marked = MARK + text.replace(MARK, _LITERAL).replace(" ", MARK)
        return self.splitter.findall(marked) if self.by_word else [marked]


def _steps(local: np.ndarray, short: np.ndarray) -> Iterator[tuple[int, tuple[int, int]]]:
    most = int(local[short].max()) if short.any() else 0
    at = np.searchsorted(local, np.arange(1, most + 2))
    for j in range(most):
        if at[j] < at[j + 1] and short[at[j] : at[j + 1]].any():
            yield j + 1, (int(at[j]), int(at[j + 1]))


class _Encoder:
    """Encodes texts; a word's tokens are kept in one flat array while the memo has room."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.starts, self.sizes, self.scores = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def _learn(self, words: list[str]) -> None:
        got, scores = [], []
        for part in _by_chars(words):
            a, b = self.pieces.viterbi(part)
            got += a
            scores.append(b)
        sizes = np.array([len(x) for x in got], dtype=np.int64)
        self.memo.update(zip(words, range(len(self.memo), len(self.memo) + len(words))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat = np.concatenate([self.flat, *got])
        self.sizes, self.scores = np.concatenate([self.sizes, sizes]), np.concatenate([self.scores, *scores])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all texts in one array, tokens of each text, and scores."""
        split = [self.pieces.words(t) for t in texts]
        if len(self.memo) > MEMO_WORDS or len(self.flat) > 20 * MEMO_WORDS:
            self._clear()
        if new := sorted(w for w in set().union(*split) if w not in self.memo):
            self._learn(new)
        n = np.array([len(s) for s in split], dtype=np.int64)
        k = np.fromiter((i for s in split for i in map(self.memo.__getitem__, s)), dtype=np.int64, count=int(n.sum()))
        sizes = self.sizes[k]
        ends = np.cumsum(sizes)
        tokens = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[k] - (ends - sizes), sizes)]
        stop = np.concatenate([[0], np.cumsum(n)])
        total, score = np.concatenate([[0], ends]), np.concatenate([[0], np.cumsum(self.scores[k])])
        return tokens, np.diff(total[stop]), np.diff(score[stop])


def _by_chars(words: list[str], most: int = 50_000) -> Iterator[list[str]]:
    part, size = [], 0
    for w in words:
        if part and size + len(w) > most:
            yield part
            part, size = [], 0
        part.append(w)
        size += len(w)
    if part:
        yield part


_encoders: dict[str, _Encoder] = {}


def _load(model_file: str) -> tuple[Pieces, list[bytes], str]:
    import sentencepiece

    blob = Path(model_file).read_bytes()
    pieces = Pieces.from_model(blob)
    sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
    return pieces, pieces.piece_bytes({int(i): sp.id_to_piece(int(i)) for i in pieces.ids[:-1]}), hashlib.md5(blob).hexdigest()


def encode_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text, token_ids (array<int>), score of the best segmentation of every whole text.

    The trie is built once by the driver from the vocabulary file and broadcast (some MB). A marker is put before the
    text and stands for each space; characters that no piece has become their UTF-8 bytes' pieces, and so does a marker
    character of the text itself, so decoding gives back the text exactly. Words between markers are encoded alone where
    the vocabulary has no piece that reaches over one, and once while a worker remembers them.
    Null texts count as empty and have no tokens. Ids and rows may be null or repeat. Other columns aren't looked at.
    A file that says it holds merges (BPE) has its ranks read as log scores by Zipf's law, see Pieces.
    """
    pieces, _, digest = _load(model_file)
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if digest not in _encoders:
            _encoders.clear()
            _encoders[digest] = _Encoder(sent.value)
        for batch in batches:
            for part in by_bytes(batch, 1 << 20):
                tokens, sizes, score = _encoders[digest].encode(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(tokens, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), ids, pa.array(score)], names=["id", "text", "token_ids", "score"])
        trim()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), as_text(text_col).alias("text"))
    return rows.mapInArrow(encode, f"id {kind}, text string, token_ids array<int>, score double").withColumnRenamed("id", id_col)


def decode_pieces(rows: DataFrame, model_file: str, ids_col: str = "token_ids", into: str = "decoded") -> DataFrame:
    """rows with the text that their tokens stand for: markers become spaces, bytes characters, and the first space goes.

    Bytes that aren't UTF-8 become replacement characters, ids out of the vocabulary and control pieces nothing. Null
    ids give null. A column named as `into` is replaced.
    """
    _, names, _ = _load(model_file)
    sent = rows.sparkSession.sparkContext.broadcast(names)

    @F.pandas_udf("string")
    def decode(ids):
        import pandas as pd

        table = sent.value
        top = len(table)

        def one(x):
            if x is None:
                return None
            x = np.asarray(x)
            if len(x) and not (0 <= x.min() and x.max() < top):
                x = x[(x >= 0) & (x < top)]
            text = b"".join(map(table.__getitem__, x.tolist())).decode("utf-8", "replace")
            return text[1:] if text.startswith(" ") else text

        return pd.Series([one(x) for x in ids], dtype="object")

    return rows.withColumn(into, decode(ids_col))

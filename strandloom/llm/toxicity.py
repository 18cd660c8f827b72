"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import re

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import as_text, by_bytes, replaced, trim

#: Labelled rows a model is fitted on at most, of each class.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 6000
BUCKETS, DIM, GRAMS = 1 << 18, 8, (3, 4, 5)
THRESHOLD = 0.7
#: Subwords without any weight that every mean counts in, so a handful of subwords can't decide alone.
NEUTRAL = 150
_WORD = re.compile(r"\w+")
MEMO_WORDS = 100_000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def subwords(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every character n-gram of <word> and of the whole word; rolling hashes over one buffer of code points."""
    buf = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(len(buf))
    mult, who, what = np.uint64(0x9E3779B97F4A7C15), [], []

    def bucket(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)

    h = np.zeros(len(buf), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            step = np.zeros(len(buf), dtype=np.uint64)
            step[: len(buf) - n + 1] = buf[n - 1 :]
            h = h * mult + step + np.uint64(1)
            if n in GRAMS:
                ok = place + n <= ends
                who.append(owner[ok])
                what.append(bucket(h[ok] + np.uint64(n)))
        if len(words):
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()) - 1, mult, dtype=np.uint64)]))
            starts = np.cumsum(sizes) - sizes
            whole = np.add.reduceat((buf + np.uint64(7)) * powers[place - np.repeat(starts, sizes)], starts)
            who.append(np.arange(len(words)))
            what.append(bucket(whole))
    return np.concatenate(who), np.concatenate(what)


class SubwordBag:
    """A document is the mean of its subwords' embeddings; a softmax over two classes stands on it. Empty texts are the bias alone."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.out = rng.normal(0, 10.0, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, dtype=np.float32)

    def fit(self, texts: list[str], labels: list[int], epochs: int = 12, batch: int = 256, rate: float = 0.15, decay: float = 2e-3, toxic_weight: float = 2.0, least_steps: int = 240, seed: int = 11) -> "SubwordBag":
        """fit_bags over the words of texts."""
        number: dict[str, int] = {}
        docs = []
        for t in texts:
            ids, n = np.unique(np.array([number.setdefault(w, len(number)) for w in words_of(t)], dtype=np.int64), return_counts=True)
            docs.append((ids.astype(np.int32), n.astype(np.float32)))
        return self.fit_bags(list(number), docs, labels, epochs, batch, rate, decay, toxic_weight, least_steps, seed)

    def fit_bags(self, known: list[str], docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 12, batch: int = 256, rate: float = 0.15, decay: float = 2e-3, toxic_weight: float = 2.0, least_steps: int = 240, seed: int = 11) -> "SubwordBag":
        """docs: for each the places in `known` of its distinct words, and how often each stands there.

        Adam over minibatches; embeddings and softmax move together; a small sample is gone through more often, until
        `least_steps` steps are made.
        """
        y = np.array(labels, dtype=np.float32)
        if not known or y.min(initial=1) == y.max(initial=0):
            rate_of = (y.sum() + 1) / (len(y) + 2)
            self.bias = np.log(np.array([1 - rate_of, rate_of], dtype=np.float32))
            self.emb[:] = 0
            return self
        what, subs = [], []
        for first in range(0, len(known), 5_000):
            part = known[first : first + 5_000]
            who, found = subwords(part)
            what.append(found[np.argsort(who, kind="stable")].astype(np.int32))
            subs.append(np.bincount(who, minlength=len(part)))
        what, subs = np.concatenate(what), np.concatenate(subs)
        at = np.concatenate([[0], np.cumsum(subs)])
        rng, t = np.random.default_rng(seed), 0
        state = [(np.zeros_like(x), np.zeros_like(x)) for x in (self.emb, self.out, self.bias)]

        def step(x: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray) -> None:
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= np.float32(now / (1 - 0.9**t)) * m / (np.sqrt(v / np.float32(1 - 0.999**t)) + np.float32(1e-8))

        epochs = max(epochs, -(-least_steps // max(1, len(docs) // batch)))
        for epoch in range(epochs):
            now = rate * (1 - epoch / epochs)
            for part in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // batch)):
                t += 1
                ids = np.concatenate([docs[i][0] for i in part])
                n = np.concatenate([docs[i][1] for i in part])
                doc = np.repeat(np.arange(len(part)), [len(docs[i][0]) for i in part])
                used, word = np.unique(ids, return_inverse=True)
                flat = what[_ranges(at[used], at[used + 1])]
                owner = np.repeat(np.arange(len(used)), subs[used])
                total = np.bincount(doc, n * subs[ids], len(part)) + NEUTRAL
                # between two classes only the difference of their columns counts, in the scores and in the gradients
                gap = self.emb @ (self.out[:, 1] - self.out[:, 0])
                of_word = np.bincount(owner, gap[flat], len(used))
                z = np.bincount(doc, n * of_word[word], len(part)) / total + self.bias[1] - self.bias[0]
                g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[part]) * np.where(y[part] == 1, toxic_weight, 1.0) / len(part)
                a = np.bincount(word, n * (g / total)[doc], len(used))
                b = np.bincount(flat, a[owner], BUCKETS).astype(np.float32)
                ge = np.outer(b, self.out[:, 1] - self.out[:, 0]) + np.float32(decay / len(docs)) * self.emb
                go = self.emb.T @ b
                for x, gx, (m, v) in zip((self.emb, self.out, self.bias), (ge, np.stack([-go, go], 1), np.array([-g.sum(), g.sum()], np.float32)), state):
                    step(x, gx, m, v)
        return self

    def weights(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log odds of class 1 before averaging, and the bias: all that scoring needs."""
        return (self.emb @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Scorer:
    """Scores texts by the weights of their words' subwords; a word's sum is worked out once while it stays in the memo."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.memo: dict[str, int] = {}
        self.sums = np.zeros((0, 2))

    def _learn(self, words: list[str]) -> None:
        found = []
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            who, what = subwords(part)
            found.append(np.stack([np.bincount(who, self.weights[what], len(part)), np.bincount(who, minlength=len(part))], 1))
        self.memo.update(zip(words, range(len(self.memo), len(self.memo) + len(words))))
        self.sums = np.concatenate([self.sums, *found])

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), float(self.bias))
        for at in range(0, len(texts), 256):
            part = [words_of(t) for t in texts[at : at + 256]]
            if len(self.memo) > MEMO_WORDS:
                self.memo, self.sums = {}, np.zeros((0, 2))
            if new := set().union(*part) - self.memo.keys():
                self._learn(sorted(new))
            get = self.memo.__getitem__
            for i, ws in enumerate(part):
                if ws:
                    total, n = self.sums[np.fromiter(map(get, ws), dtype=np.int64, count=len(ws))].sum(0)
                    out[at + i] += total / (n + NEUTRAL)
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


_scorers: dict[str, Scorer] = {}


def held_out(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, mod 3, is 1: such rows teach nothing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, y, words, counts) of rows (i, t, y): each text as its distinct words."""
    for batch in batches:
        for part in by_bytes(batch):
            found = [Counter(words_of(t)) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))], names=["i", "y", "words", "counts"])
    trim()


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(weights, bias) of the model of all bags that come, in order of their ids."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    got = pa.Table.from_batches(held).sort_by("i").combine_chunks()
    words, counts = got.column("words").combine_chunks(), got.column("counts").combine_chunks()
    code = words.flatten().dictionary_encode()
    place, n = code.indices.to_numpy().astype(np.int32), counts.flatten().to_numpy().astype(np.float32)
    ends = np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))
    bags = list(zip(np.split(place, ends[:-1]), np.split(n, ends[:-1])))
    known, marks = code.dictionary.to_pylist(), got.column("y").to_pylist()
    del held, got, words, counts, code
    trim()
    weights, bias = SubwordBag().fit_bags(known, bags, marks).weights()
    del known, bags, marks, place, n
    trim()
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])


@dataclass(frozen=True)
class Weights:
    """What scoring needs of a fitted model."""

    buckets: np.ndarray
    bias: float

    def weights(self) -> tuple[np.ndarray, float]:
        return self.buckets, self.bias


def sample_bags(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, y, words, counts): the labelled rows that a model is fitted on, each whole text as its distinct words and their counts; see fit_toxicity."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("i")).agg(F.max("toxic").cast("int").alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    known = known.join(texts.select("i"), "i", "left_semi")
    order = [F.xxhash64(F.lit("sample"), "i"), F.col("i")]
    chosen = known.where("y = 1").orderBy(*order).limit(toxic).unionByName(known.where("y = 0").orderBy(*order).limit(clean))
    rows = texts.join(F.broadcast(chosen), "i").groupBy("i").agg(F.min("t").alias("t"), F.max("y").alias("y"))
    return rows.mapInArrow(_bags, "i long, y int, words array<string>, counts array<int>")


def fit_toxicity(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, id_col: str = "doc_id", text_col: str = "text") -> Weights:
    """Fit on a bounded sample of the labelled rows that aren't held out.

    Of each class of the labelled rows that have a text, of whatever length, the rows with the smallest hash of their id
    are taken, `toxic` and `clean` at most. Only ids of the sample are broadcast. Whole texts become counts of words where
    they are read, one task trains on these, and the weights reach the driver. A repeated id stands for its smallest
    text; it is toxic if any label says so. Null ids and null labels teach nothing. Without rows of both classes only the
    share of toxic ones is learned.
    """
    row = sample_bags(docs, labels, toxic, clean, id_col, text_col).repartition(1).mapInArrow(_trained, "weights binary, bias double").first()
    if row is None:
        return Weights(*SubwordBag().fit_bags([], [], []).weights())
    return Weights(np.frombuffer(row["weights"], dtype=np.float32), row["bias"])


def score_toxicity(docs: DataFrame, model: Weights | SubwordBag, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with held_out, score (0 to 1, higher where toxic is likelier) and predicted (1 from threshold on).

    Every whole text is scored: the mean over all its subwords, whatever its length. Null texts count as empty; texts
    without words get the bias alone. Ids may be null (never held out) or repeat. All columns stay; those three are added,
    and take the place of columns of these names. The weights (1 MB) are broadcast.
    """
    weights, bias = model.weights()
    name = f"{hash(weights.tobytes())}:{bias}"
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(*sent.value)
        return pd.Series(_scorers[name].scores(texts.tolist()))

    scored = replaced(docs, {"held_out": held_out(id_col), "score": score(as_text(text_col))})
    return replaced(scored, {"predicted": F.when(F.col("score") >= threshold, 1).otherwise(0)})

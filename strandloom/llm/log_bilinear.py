"""Language model scoring: a log-bilinear model trained in numpy by noise-contrastive estimation, over exact corpus counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import as_text, by_bytes, stash

#: Tokens that executors hold with their counts (the most frequent, this many at most), and those among them with a symbol of their own.
HOT_TOKENS, OWN_SYMBOLS = 100_000, 4_066
#: Symbols of the model: the text's end, the most frequent tokens, hot tokens by order of magnitude, all others by length.
HOT_BUCKETS, RARE_LENGTHS = 24, (5, 8, 11, 14, 1 << 62)
#: Length of a symbol's vector; noise classes of a batch, noise symbols of a row, rows of a batch.
DIM, NOISE_CLASSES, NOISE_SYMBOLS, BATCH = 16, 24, 3, 2048
#: Training tokens of a shard, about; rows that all shards together are gone through for at least, in so many passes at most.
SHARD_TOKENS, LEAST_ROWS, MOST_PASSES = 2_000_000, 8_000_000, 24
FLUSH_TOKENS, PART_BYTES, CHUNK = 200_000, 2 << 20, 1 << 16


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def held_out(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, mod 7, is 2: such documents teach nothing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def token_counts(texts: DataFrame) -> DataFrame:
    """(token binary, c long) over all whole texts of column t. A task counts in a table that it empties when that is full; the sums come after a shuffle by token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["token", "c"])

        for batch in batches:
            for part in by_bytes(batch):
                for t in part.column(0).to_pylist():
                    seen.update(tokens(t))
                    if len(seen) > FLUSH_TOKENS:
                        yield out()
                        seen.clear()
        yield out()

    return texts.select("t").mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _magnitude() -> F.Column:
    """Bins of counts, eight for a doubling."""
    return F.floor(F.log2("c") * 8).cast("int")


class Vocabulary:
    """The hot tokens with counts and symbols, and the sizes of what lies outside them. Bounded by HOT_TOKENS.

    Symbols are numbered by falling count, ties in the order end, own ones, buckets, lengths. They make classes of equal
    size, the square root of their number, the most frequent first; `mass` has their counts.
    """

    def __init__(self, hot: list[tuple[bytes, int]], ends: int, rare: dict[int, tuple[int, int]], total: int, distinct: int) -> None:
        hot = sorted(hot, key=lambda x: (-x[1], x[0]))
        self.total, self.distinct, self.ends = total, distinct, ends
        self.index = {t: i for i, (t, _) in enumerate(hot)}
        c = np.array([n for _, n in hot], dtype=np.float64)
        own = min(len(hot), OWN_SYMBOLS)
        sym = np.arange(1, len(hot) + 1)
        if len(hot) > own:
            tail = np.log2(c[own:])
            width = max(1e-9, (tail[0] - tail[-1]) / HOT_BUCKETS)
            sym[own:] = 1 + own + np.minimum(HOT_BUCKETS - 1, ((tail[0] - tail) / width).astype(int))
        first_rare = 1 + own + HOT_BUCKETS
        mass = np.bincount(sym, c, first_rare + len(RARE_LENGTHS))
        mass[0] = ends
        mass[first_rare:] = [rare.get(b, (0, 0))[0] for b in range(len(RARE_LENGTHS))]
        order = np.argsort(-mass, kind="stable")
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        self.mass = mass[order]
        self.end, self.symbol, self.rare_symbol = int(number[0]), number[sym], number[first_rare:]
        self.size = len(order)
        self.width = int(np.ceil(np.sqrt(self.size)))  # symbols of a class
        self.log_count = np.log10(c + 1)
        self.within = np.log10(c / mass[sym]) if len(hot) else c
        #: For tokens that aren't hot: log10 of what their count plus one is divided by, within their length class.
        self.rare_log = np.array([np.log10(sum(rare.get(b, (0, 0))) + 1) for b in range(len(RARE_LENGTHS))])


def rare_bucket(length: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(RARE_LENGTHS), length)


def encode(texts: list[str], vocab: Vocabulary) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text; over all of them the hot token's number (-1 to -5: not hot, by length; -9: the end) and the symbol; tokens of each text with its end."""
    toks = [tokens(t) for t in texts]
    sizes = np.array([len(x) + 1 for x in toks], dtype=np.int64)
    ends = np.cumsum(sizes) - 1
    hot = np.full(int(sizes.sum()), -9, dtype=np.int64)
    inner = np.ones(len(hot), dtype=bool)
    inner[ends] = False
    found = np.fromiter(map(vocab.index.get, chain.from_iterable(toks), repeat(-1)), dtype=np.int64, count=int(inner.sum()))
    if (rare := np.flatnonzero(found < 0)).size:
        flat = list(chain.from_iterable(toks))
        found[rare] = -1 - rare_bucket(np.fromiter((len(flat[i]) for i in rare.tolist()), dtype=np.int64, count=len(rare)))
    hot[inner] = found
    symbol = np.full(len(hot), vocab.end, dtype=np.int64)
    symbol[hot >= 0] = vocab.symbol[hot[hot >= 0]]
    rare = (hot < 0) & inner
    symbol[rare] = vocab.rare_symbol[-1 - hot[rare]]
    return toks, hot, symbol, sizes


def trigrams(symbol: np.ndarray, sizes: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """One number for each symbol and the two before it; before a text stand ends."""
    one = np.concatenate([[vocab.end], symbol[:-1]])
    two = np.concatenate([[vocab.end, vocab.end], symbol[:-2]])[: len(symbol)]
    starts = np.cumsum(sizes) - sizes
    second = starts[sizes > 1] + 1
    one[starts] = vocab.end
    two[starts] = vocab.end
    two[second] = vocab.end
    return (two * vocab.size + one) * vocab.size + symbol


def trigram_counts(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(code, n): how often each symbol follows each two, over all whole texts; a code may have several rows. Tasks add up what they hold of some million tokens."""
    sent = texts.sparkSession.sparkContext.broadcast(vocab)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for i in range(0, len(code), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(code[i : i + 100_000]), pa.array(n[i : i + 100_000])], names=["code", "n"])

        for batch in batches:
            for part in by_bytes(batch, PART_BYTES):
                _, _, symbol, sizes = encode(part.column(0).to_pylist(), sent.value)
                held.append(trigrams(symbol, sizes, sent.value))
                if sum(map(len, held)) > 4_000_000:
                    yield from out()
        if held:
            yield from out()

    return texts.select("t").mapInArrow(count, "code long, n long")


def _sums(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places in order, and the sum of the rows of each."""
    order = np.argsort(at.astype(np.uint16) if int(at.max()) < 1 << 16 else at, kind="stable")  # two bytes are sorted by radix
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.add.reduceat(rows[order], first, axis=0)


class LogBilinear:
    """The two symbols before predict a vector, each through its own matrix; its product with a class's vector, plus a bias, scores the class, and with a symbol's the symbol within its class.

    Parameters: context (a symbol's vector as context), target and classes (vectors with the bias as last number), and the
    two matrices. Both levels are trained by noise-contrastive estimation and normalised when texts are scored.
    """

    NAMES = ("context", "target", "classes", "near", "far")

    def __init__(self, vocab: Vocabulary, dim: int = DIM, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.size, self.width, self.dim = vocab.size, vocab.width, dim
        n_classes = -(-vocab.size // vocab.width)
        p = (vocab.mass + 0.5) / (vocab.mass.sum() + 0.5 * vocab.size)
        self.of = np.arange(vocab.size) // vocab.width
        self.p_class = np.bincount(self.of, p, n_classes)
        self.p_within = p / self.p_class[self.of]
        self.cdf = np.concatenate([[0.0], np.cumsum(p)])
        self.context = rng.normal(0, 0.3, (vocab.size, dim)).astype(np.float32)
        self.target = np.concatenate([rng.normal(0, 0.05, (vocab.size, dim)), np.log(self.p_within)[:, None]], axis=1).astype(np.float32)
        self.classes = np.concatenate([rng.normal(0, 0.05, (n_classes, dim)), np.log(self.p_class)[:, None]], axis=1).astype(np.float32)
        self.near, self.far = np.eye(dim, dtype=np.float32), np.eye(dim, dtype=np.float32) * np.float32(0.5)

    def _split(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return code // (self.size * self.size), code // self.size % self.size, code % self.size

    def fit(self, code: np.ndarray, n: np.ndarray, passes: int, rate: float = 0.1, seed: int = 5) -> "LogBilinear":
        """Noise-contrastive estimation over counted trigrams: tell each observed class from drawn classes, and each symbol from symbols drawn within its class, by logistic regression on the scores; Adagrad.

        A trigram that is frequent stands in a pass as often as its count's logarithm, with its count shared among them.
        """
        reps = 1 + np.log2(np.maximum(n, 1)).astype(np.int64)
        rows, weight = np.repeat(np.arange(len(code), dtype=np.int32), reps), np.repeat((n / reps).astype(np.float32), reps)
        weight /= max(1e-9, float(weight.mean(dtype=np.float64))) if len(weight) else 1
        rng = np.random.default_rng(seed)
        seen = {name: np.full_like(getattr(self, name), 1e-2) for name in self.NAMES}
        class_cdf = np.cumsum(self.p_class)
        offset_class = np.log(NOISE_CLASSES * self.p_class).astype(np.float32)
        offset = np.log(NOISE_SYMBOLS * self.p_within).astype(np.float32)
        steps = passes * -(-len(rows) // BATCH)
        step = 0

        def move(name: str, at, g: np.ndarray) -> None:
            seen[name][at] += g * g
            getattr(self, name)[at] -= np.float32(now) * g / np.sqrt(seen[name][at])

        for _ in range(passes):
            order = rng.permutation(np.arange(len(rows), dtype=np.int32))
            for lo in range(0, len(rows), BATCH):
                now = rate * (1 - step / steps)
                step += 1
                pick = order[lo : lo + BATCH]
                two, one, sym = self._split(code[rows[pick]])
                w = weight[pick]
                a, b = self.context[one], self.context[two]
                h = np.concatenate([a @ self.near + b @ self.far, np.ones((len(w), 1), np.float32)], axis=1)
                # classes: the noise of a batch is drawn once
                cls = self.of[sym]
                noise = np.minimum(np.searchsorted(class_cdf, rng.random(NOISE_CLASSES) * class_cdf[-1], side="right"), len(class_cdf) - 1)
                g_pos = (_sigmoid((h * self.classes[cls]).sum(1) - offset_class[cls]) - 1) * w
                g_neg = _sigmoid(h @ self.classes[noise].T - offset_class[noise]) * w[:, None]
                gh = g_pos[:, None] * self.classes[cls] + g_neg @ self.classes[noise]
                hit = np.zeros((len(w), len(self.classes)), np.float32)
                hit[np.arange(len(w)), cls] = g_pos
                g_classes = hit.T @ h
                np.add.at(g_classes, noise, g_neg.T @ h)
                # symbols: each row draws its noise within its class
                low, high = self.cdf[cls * self.width], self.cdf[np.minimum((cls + 1) * self.width, self.size)]
                drawn = np.searchsorted(self.cdf, low[:, None] + rng.random((len(w), NOISE_SYMBOLS)) * (high - low)[:, None], side="right") - 1
                drawn = np.clip(drawn, (cls * self.width)[:, None], np.minimum((cls + 1) * self.width, self.size)[:, None] - 1)
                both = np.concatenate([sym[:, None], drawn], axis=1)
                vec = self.target[both]
                g = _sigmoid(np.einsum("bd,bkd->bk", h, vec) - offset[both])
                g[:, 0] -= 1
                g *= w[:, None]
                gh += np.einsum("bk,bkd->bd", g, vec)
                at, g_target = _sums(both.reshape(-1), (g[:, :, None] * h[:, None, :]).reshape(-1, self.dim + 1))
                gh = gh[:, :-1]
                of, g_context = _sums(np.concatenate([one, two]), np.concatenate([gh @ self.near.T, gh @ self.far.T]))
                for name, place, grad in (("near", slice(None), a.T @ gh), ("far", slice(None), b.T @ gh), ("classes", slice(None), g_classes), ("target", at, g_target), ("context", of, g_context)):
                    move(name, place, grad.astype(np.float32))
        return self

    def rows(self) -> dict[str, np.ndarray]:
        """part, at, and DIM + 1 numbers of each row of each parameter."""
        blocks = [np.pad(x, ((0, 0), (0, self.dim + 1 - x.shape[1]))) for x in (getattr(self, name) for name in self.NAMES)]
        flat = np.concatenate(blocks).astype(np.float64)
        out = {"part": np.concatenate([np.full(len(x), k, dtype=np.int32) for k, x in enumerate(blocks)]), "at": np.concatenate([np.arange(len(x), dtype=np.int32) for x in blocks])}
        return out | {f"v{j}": flat[:, j] for j in range(self.dim + 1)}

    def take(self, rows: dict[str, np.ndarray]) -> "LogBilinear":
        """The parameters that rows() gives, in any order."""
        flat = np.stack([rows[f"v{j}"] for j in range(self.dim + 1)], axis=1)
        for k, name in enumerate(self.NAMES):
            some = rows["part"] == k
            x = getattr(self, name)
            x[rows["at"][some]] = flat[some][:, : x.shape[1]]
        return self

    def scorer(self) -> "Scorer":
        return Scorer(self)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Scorer:
    """Normalised log10 probabilities of symbols after two, by batched products: over all classes, then over the symbols of the class."""

    def __init__(self, model: LogBilinear) -> None:
        self.size, self.width = model.size, model.width
        ones = lambda x, fill: np.concatenate([x, np.full((len(x), 1), fill, np.float32)], axis=1)
        self.near, self.far = ones(model.context @ model.near, 1), ones(model.context @ model.far, 0)
        self.classes, self.target = model.classes, model.target

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each trigram."""
        every, back = np.unique(code, return_inverse=True)
        return np.concatenate([np.empty(0), *(self._chunk(every[i : i + CHUNK]) for i in range(0, len(every), CHUNK))])[back]

    def _chunk(self, code: np.ndarray) -> np.ndarray:
        two, one, sym = code // (self.size * self.size), code // self.size % self.size, code % self.size
        cls = sym // self.width
        order = np.argsort(cls, kind="stable")
        two, one, sym, cls = two[order], one[order], sym[order], cls[order]
        h = self.near[one] + self.far[two]
        out = np.concatenate([_log_share(h[i : i + BATCH] @ self.classes.T, cls[i : i + BATCH]) for i in range(0, len(h), BATCH)])
        edge = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1], [True]]))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            first = int(cls[lo]) * self.width
            out[lo:hi] += _log_share(h[lo:hi] @ self.target[first : first + self.width].T, sym[lo:hi] - first)
        back = np.empty(len(out))
        back[order] = out / np.log(10)
        return back


def _log_share(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """ln of each row's softmax at one place."""
    top = z.max()
    if top - z.min() > 60:  # too wide for one shift of all rows
        top = z.max(1, keepdims=True)
    z = z - top
    return (z[np.arange(len(z)), at] - np.log(np.exp(z).sum(1))).astype(np.float64)


def fit_model(counts: DataFrame, vocab: Vocabulary, tokens_seen: int) -> LogBilinear:
    """Train a model on each shard of the counted trigrams (code, n) and average their parameters.

    A shard has a hash's share of all trigrams, some million tokens' worth; all start from the same parameters, so their
    mean is a model. Sums are combined where they arise, and the parameters' rows reach the driver: they are as many as
    symbols, not shards. A small corpus is gone through more often.
    """
    shards = max(1, -(-tokens_seen // SHARD_TOKENS))
    model = LogBilinear(vocab)
    sent = counts.sparkSession.sparkContext.broadcast(model)
    values = [f"v{j}" for j in range(model.dim + 1)]

    def train(g: pa.Table) -> pa.Table:
        import copy

        code, back = np.unique(g.column("code").to_numpy(), return_inverse=True)
        n = np.bincount(back, g.column("n").to_numpy())
        del back
        own = copy.deepcopy(sent.value)
        own.fit(code, n, min(MOST_PASSES, -(-LEAST_ROWS // (shards * len(code)))))
        rows = own.rows()
        return pa.table(rows | {"w": np.full(len(rows["at"]), float(n.sum()))})

    dealt = counts.select(F.pmod(F.xxhash64("code"), F.lit(shards)).alias("shard"), "code", "n")
    trained = dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(train, f"part int, at int, {', '.join(f'{v} double' for v in values)}, w double")
    mean = trained.groupBy("part", "at").agg(*((F.sum(F.col(v) * F.col("w")) / F.sum("w")).alias(v) for v in values)).toArrow()
    return model.take({c: mean.column(c).to_numpy() for c in mean.column_names}) if mean.num_rows else model


def fit_vocabulary(counts: DataFrame, ends: int, hot_tokens: int = HOT_TOKENS) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and the counts of the tokens outside it. Which counts are hot follows from a histogram of their bins, a few hundred rows."""
    bins = {r["m"]: (r["v"], r["n"]) for r in counts.groupBy(_magnitude().alias("m")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).collect()}
    cut, held = max(bins, default=0) + 1, 0
    for m in sorted(bins, reverse=True):
        held += bins[m][0]
        if held > hot_tokens or m == 0:  # tokens seen once stay outside: what they weigh is what unseen ones may
            break
        cut = m
    hot = counts.where(_magnitude() >= cut).toArrow()
    others = counts.where(_magnitude() < cut)
    bucket = sum(((F.octet_length("token") > n).cast("int") for n in RARE_LENGTHS[:-1]), F.lit(0))
    rare = {r["b"]: (r["n"], r["v"]) for r in others.groupBy(bucket.alias("b")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    total, distinct = sum(n for _, n in bins.values()) + ends, sum(v for v, _ in bins.values()) + (ends > 0)
    return Vocabulary(list(zip(hot.column("token").to_pylist(), hot.column("c").to_pylist())), ends, rare, total, distinct), others


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """Every whole text's base score and log-bilinear score, learned from the documents that aren't held out.

    Counts are over all training texts: tokens, and trigrams of symbols, are counted in tasks and summed after a shuffle.
    The model is trained on the counted trigrams in shards. Documents are scored against the hot tokens (broadcast,
    `hot_tokens` at most) where they are read; each one's other tokens, once with their number, are joined with the full
    counts and their logarithms summed. The model's probability of a token is that of its symbol after two symbols,
    normalised over all symbols, times that of the token within its symbol: 1 for a token with a symbol of its own, its
    share of the counts in a bucket or, among tokens that aren't hot, (c + 1) / (their count + their number + 1) of the
    same length class.

    Null texts count as empty: an end alone. Null ids are never held out; ids and rows may repeat. Other columns aren't
    looked at. Without training documents every token has the probability of its class. An empty table gives an empty one.

    Returns id_col, held_out, n_tokens, n_known, train_tokens (long), base_score, score (double).
    """
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), as_text(text_col).alias("t"))
    train = rows.where("not held_out")
    ends = train.count()
    counts = stash(token_counts(train))
    vocab, others = fit_vocabulary(counts, ends, hot_tokens)
    model = fit_model(trigram_counts(train, vocab), vocab, vocab.total)
    sent = docs.sparkSession.sparkContext.broadcast((vocab, model.scorer()))
    schema = "id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<token:binary,m:long>>"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, scorer = sent.value
        of_end, full = np.log10(v.ends + 1), np.log10(v.total + v.distinct + 1)
        for batch in batches:
            for part in by_bytes(batch, PART_BYTES):
                toks, hot, symbol, sizes = encode(part.column(2).to_pylist(), v)
                starts = np.cumsum(sizes) - sizes
                s = scorer.score(trigrams(symbol, sizes, v))
                base = np.full(len(hot), of_end)
                known = np.full(len(hot), int(v.ends > 0), dtype=np.int64)
                is_hot, is_rare = hot >= 0, (hot < 0) & (hot > -9)
                base[is_hot], known[is_hot] = v.log_count[hot[is_hot]], 1
                base[is_rare], known[is_rare] = 0, 0
                s[is_hot] += v.within[hot[is_hot]]
                s[is_rare] -= v.rare_log[-1 - hot[is_rare]]
                rare = [Counter(x[i] for i in np.flatnonzero(is_rare[a : a + len(x)]).tolist()) for x, a in zip(toks, starts.tolist())]
                items = pa.StructArray.from_arrays([pa.array(list(chain.from_iterable(rare)), pa.binary()), pa.array(list(chain.from_iterable(r.values() for r in rare)), pa.int64())], names=["token", "m"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rare)]), pa.int32()), items)
                out = [part.column(0), part.column(1), pa.array(sizes), pa.array(np.add.reduceat(known, starts)), pa.array(np.add.reduceat(base, starts) - sizes * full), pa.array(np.add.reduceat(s, starts)), lists]
                yield pa.RecordBatch.from_arrays(out, names=["id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])

    scored = stash(rows.select(F.col("id").cast("long"), "held_out", "t").mapInArrow(score, schema).withColumn("rid", F.monotonically_increasing_id()))
    each = scored.select("rid", F.explode("rare").alias("r")).select("rid", "r.token", "r.m")
    known = each.join(others.select("token", "c"), "token").groupBy("rid").agg(F.sum(F.col("m") * F.log10(F.col("c") + 1)).alias("more"), F.sum("m").alias("k"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(known, "rid", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )

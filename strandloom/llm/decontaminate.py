"""Benchmark decontamination by greedy string tiling over shared-token seeds."""

from __future__ import annotations

import heapq
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import as_text, stash
from strandloom.llm.shingles import words

#: Bytes of benchmark text that are broadcast at once; a larger benchmark is worked through in blocks of that size.
BLOCK_BYTES = 16 << 20
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _windows(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of n known words, and their Karp-Rabin hashes: a window's hash follows from the running one at its ends."""
    if len(ids) < n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    gaps = np.concatenate([[0], np.cumsum(ids < 0)])
    at = np.flatnonzero(gaps[n:] == gaps[:-n])
    with np.errstate(over="ignore"):
        # running[k] = sum of (id + 1) base**i over the first k words; windows are compared after a shift to their start
        x = ids.astype(np.uint64) + np.uint64(1)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(ids) - 1, _BASE, dtype=np.uint64)]))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(ids) - 1, np.uint64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64)]))
        running = np.concatenate([[np.uint64(0)], np.cumsum(x * powers)])
        h = (running[at + n] - running[at]) * back[at]
        return at, (h ^ (h >> np.uint64(32))) * _BASE


def matches(item: np.ndarray, text: np.ndarray, n: int, places: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal runs (start in item, start in text, length) of n or more equal words.

    places[k] is a window of the item that also stands in the text, there at order[starts[k]:ends[k]]. Windows that follow
    each other on a diagonal are one run. One window of the item is worked on at a time, so memory is the two lengths',
    however often words repeat.
    """
    runs: list[np.ndarray] = []
    first = np.full(len(item) + len(text) + 1, -1, dtype=np.int64)
    last = np.full(len(first), -2, dtype=np.int64)

    def close(d: np.ndarray) -> None:
        runs.append(np.stack([first[d], first[d] + d - len(item), last[d] - first[d] + n], axis=1))

    for p, a, b in zip(places.tolist(), starts.tolist(), ends.tolist()):
        t = order[a:b]
        for k in range(n):  # hashes only propose
            t = t[text[t + k] == item[p + k]]
        d = t - p + len(item)
        fresh = d[last[d] != p - 1]
        if len(done := fresh[first[fresh] >= 0]):
            close(done)
        first[fresh] = p
        last[d] = p
    close(np.flatnonzero(first >= 0))
    return [tuple(r) for r in np.concatenate(runs).tolist()]


def tile(item: np.ndarray, text: np.ndarray, runs: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: tiles (start in item, start in text, length) that don't overlap in either, longest first, of equal ones the first in the item, then in the text.

    runs: all maximal matches. The longest is marked; what marked words leave of a match goes back into the queue while it
    has n words. The search ends when no n words in a row are left in the item.
    """
    queue = [(-size, p, t) for p, t, size in runs]
    heapq.heapify(queue)
    item_free, text_free, tiles = np.ones(len(item), dtype=bool), np.ones(len(text), dtype=bool), []
    while queue:
        size, p, t = heapq.heappop(queue)
        free = item_free[p : p - size] & text_free[t : t - size]
        if free.all():
            tiles.append((p, t, -size))
            item_free[p : p - size] = False
            text_free[t : t - size] = False
            left = np.diff(np.flatnonzero(np.concatenate([[True], ~item_free, [True]])))
            if left.max() <= n:  # gaps between marked words hold n - 1 words at most
                break
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
        for k, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end - k >= n:
                heapq.heappush(queue, (k - end, p + k, t + k))
    return tiles


class _Seeds:
    """The windows of n words of a block's items: their hashes in order, and for each the item and its place there."""

    def __init__(self, n: int, ids: dict[int, np.ndarray]) -> None:
        self.n = n
        hashes, keys, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for key, x in ids.items():
            p, h = _windows(x, n)
            hashes.append(h)
            keys.append(np.full(len(p), key))
            places.append(p)
        hashes, keys, places = np.concatenate(hashes), np.concatenate(keys), np.concatenate(places)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.keys, self.places = hashes[order], keys[order], places[order]


class Items:
    """One block of benchmark items, each an id, which may be null or repeat, and a text: their words' numbers, and their seeds.

    An item of fewer than n words has one seed, of all its words.
    """

    def __init__(self, items: list[tuple[int | None, str]], n: int) -> None:
        self.number: dict[bytes, int] = {}
        self.ids: dict[int, np.ndarray] = {}
        each = sorted(set(items), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        self.names = [i for i, _ in each]
        by_length: dict[int, dict[int, np.ndarray]] = {}
        for key, (_, text) in enumerate(each):
            if w := words(text):  # an item without words is in no text
                self.ids[key] = np.array([self.number.setdefault(x, len(self.number)) for x in w], dtype=np.int64)
                by_length.setdefault(min(n, len(w)), {})[key] = self.ids[key]
        self.seeds = [_Seeds(k, ids) for k, ids in sorted(by_length.items())]

    def matches(self, text: str) -> list[tuple[int | None, float, int]]:
        """(item's id, share of its words in tiles, tiles) for each item that shares a seed with the text."""
        w = words(text)
        ids = np.fromiter(map(self.number.get, w, repeat(-1)), dtype=np.int64, count=len(w))
        out = {}
        for seeds in self.seeds:
            n = seeds.n
            at, h = _windows(ids, n)
            if not len(at):
                continue
            hit = seeds.hashes[np.minimum(np.searchsorted(seeds.hashes, h), len(seeds.hashes) - 1)] == h
            at, h = at[hit], h[hit]
            if not len(at):
                continue
            order = np.argsort(h, kind="stable")
            at, h = at[order], h[order]
            some = np.flatnonzero(h[np.minimum(np.searchsorted(h, seeds.hashes), len(h) - 1)] == seeds.hashes)
            for key in np.unique(seeds.keys[some]).tolist():
                own = some[seeds.keys[some] == key]
                own = own[np.argsort(seeds.places[own], kind="stable")]
                runs = matches(self.ids[key], ids, n, seeds.places[own], at, np.searchsorted(h, seeds.hashes[own]), np.searchsorted(h, seeds.hashes[own], side="right"))
                if runs:
                    tiles = tile(self.ids[key], ids, runs, n)
                    out[key] = (self.names[key], sum(x[2] for x in tiles) / len(self.ids[key]), len(tiles))
        return [out[key] for key in sorted(out)]


def _blocks(benchmark: DataFrame, n: int, most: int, item_col: str, text_col: str):
    """The benchmark's items, `most` bytes of text at a time about; items as long as a block of their own make one."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), as_text(text_col).alias("t"))
    size = items.agg(F.sum(F.octet_length("t").cast("long")).alias("b")).first()["b"] or 0
    blocks = -(-size // most) or 1
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        yield blocks, Items([(r["i"], r["t"]) for r in part.collect()], n)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, n: int = 5, most: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with _matches, an array of (item_id, coverage, tiles) of the items that share n words in a row with the text, and contaminated.

    Seeds of n words are joined by their Karp-Rabin hash where the text is read: texts aren't shuffled. From each item's
    seeds the tiles are marked, longest first and without overlap in either text; a document is contaminated if tiles
    cover `threshold` of an item's words or more, in whatever order they stand. An item of fewer than n words is found
    where all its words stand in a row; one without words never is. Items are told apart by id and text: each text of a
    repeated id is searched and has a match of its own under that id, and so have texts with a null id. The benchmark is
    broadcast in blocks of `most` bytes; with more than one, the result is written between blocks.

    Null texts count as empty and have no matches. Ids and rows may repeat. All columns stay; those two are added, and
    take the place of columns of these names. An empty benchmark, or an empty table, gives no matches.
    """
    names = docs.columns
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row")).withColumn("_matches", F.array().cast("array<struct<item_id:long,coverage:double,tiles:int>>"))
    for blocks, items in _blocks(benchmark, n, most, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        @F.pandas_udf("array<struct<item_id:long,coverage:double,tiles:int>>")
        def matches(texts):
            import pandas as pd

            held = sent.value
            return pd.Series([[{"item_id": a, "coverage": b, "tiles": c} for a, b, c in held.matches(t)] for t in texts])

        out = out.select("_row", F.concat("_matches", matches(F.coalesce(F.col("_row")[text_col].cast("string"), F.lit("")))).alias("_matches"))
        if blocks > 1:
            out = stash(out)
    found = F.exists("_matches", lambda m: m["coverage"] >= threshold)
    kept = [F.col("_row")[c].alias(c) for c in names if c.lower() not in ("_matches", "contaminated")]
    return out.select(*kept, "_matches", found.alias("contaminated"))

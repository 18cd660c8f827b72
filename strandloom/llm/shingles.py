"""Words and word shingles as 64-bit numbers, worked out in numpy for whole batches of texts; nothing is kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: ASCII punctuation and controls become spaces; letters, digits, the underscore and all bytes beyond ASCII stay.
_SEPARATORS = bytes(b if b >= 0x80 or chr(b).isalnum() or b == 0x5F else 0x20 for b in range(256))
_MULT, _WORD_MULT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes that are hashed at once, about.
SLICE = 1 << 20


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SEPARATORS)


def words(text: str) -> list[bytes]:
    """Words in lower case: runs of letters, digits, underscores and characters beyond ASCII."""
    return _bytes(text).split()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Each byte's own random number, so that words of one length differ in every power.
with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)


def _slices(buf: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of about SLICE bytes that end behind a space; a word longer than that makes its part longer."""
    at = 0
    while at < len(buf):
        end = min(len(buf), at + SLICE)
        while end < len(buf) and buf[end - 1] != 0x20:
            gap = np.flatnonzero(buf[end : end + SLICE] == 0x20)
            end = end + int(gap[0]) + 1 if len(gap) else min(len(buf), end + SLICE)
        yield buf[at:end]
        at = end


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of all texts in one array, and the number of words of each text. A word's hash is a polynomial over its bytes' random numbers, mixed with its length."""
    parts = [_bytes(t) for t in texts]
    buf = np.frombuffer(b" ".join([*parts, b""]), dtype=np.uint8)  # each text ends with a space
    hashes, starts, base = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    with np.errstate(over="ignore"):
        for part in _slices(buf):
            inside = np.concatenate([[False], part != 0x20, [False]])
            edge = np.flatnonzero(inside[1:] != inside[:-1])
            first, size = edge[::2], edge[1::2] - edge[::2]
            if len(first):
                powers = np.cumprod(np.full(int(size.max()), _WORD_MULT, dtype=np.uint64))
                behind = np.cumsum(size) - size
                place = np.arange(int(size.sum())) - np.repeat(behind, size)
                values = _BYTE[part[inside[1:-1]]] * powers[place]
                hashes.append(mix(np.add.reduceat(values, behind) + size.astype(np.uint64) * _MULT))
                starts.append(first + base)
            base += len(part)
    flat, at = np.concatenate(hashes), np.concatenate(starts)
    ends = np.cumsum([len(p) + 1 for p in parts]) if parts else np.empty(0, np.int64)
    return flat, np.diff(np.searchsorted(at, ends), prepend=0).astype(np.int64)


def shingle_sets(texts: list[str], n: int = 5) -> list[np.ndarray]:
    """For each text the ordered distinct hashes of its shingles of n words; a text of fewer words has one shingle of them all, one of none has none."""
    flat, sizes = word_hashes(texts)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(flat) - n + 1), dtype=np.uint64)
        for k in range(n):
            rolled = rolled * _MULT + flat[k : k + len(rolled)]
        rolled = mix(rolled)
        out, at = [], 0
        for size in sizes.tolist():
            if size >= n:
                out.append(np.unique(rolled[at : at + size - n + 1]))
            elif size:
                h = np.array([size], dtype=np.uint64)
                for k in range(size):
                    h = h * _MULT + flat[at + k]
                out.append(mix(h + np.uint64(1)))
            else:
                out.append(np.empty(0, dtype=np.uint64))
            at += size
    return out

"""Nucleotide models: rate matrices, transition probabilities, branch lengths and tree likelihoods, in numpy for one family."""

from __future__ import annotations

import numpy as np

from strandloom.operators.trees import Tree

BASES = "ACGT"


def rates(model: str = "JC", kappa: float = 2.0, exchange: tuple[float, ...] = (1, 1, 1, 1, 1, 1), freqs: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25)) -> np.ndarray:
    """Rate matrix of JC, K2P, HKY or GTR (exchange: AC, AG, AT, CG, CT, GT), with one change a unit of time on average."""
    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    if model in ("JC", "K2P"):
        freqs = (0.25,) * 4
    if model == "JC":
        exchange = (1,) * 6
    elif model in ("K2P", "HKY"):
        exchange = (1, kappa, 1, 1, kappa, 1)
    elif model != "GTR":
        raise ValueError(f"no model {model}")
    q = np.zeros((4, 4))
    for (a, b), x in zip(pairs, exchange):
        q[a, b], q[b, a] = x * freqs[b], x * freqs[a]
    np.fill_diagonal(q, -q.sum(1))
    return q / -(np.diag(q) @ np.array(freqs))


def probabilities(q: np.ndarray, t: float) -> np.ndarray:
    """exp(Q t), by scaling and squaring."""
    k = max(0, int(np.ceil(np.log2(max(1e-12, np.abs(q * t).max())))) + 5)
    x = q * t / 2**k
    p, term = np.eye(4), np.eye(4)
    for i in range(1, 12):
        term = term @ x / i
        p = p + term
    for _ in range(k):
        p = p @ p
    return p


def pair_log_likelihood(a: str, b: str, t: float, q: np.ndarray) -> float:
    p = probabilities(q, t)
    return float(sum(np.log(max(p[BASES.index(x), BASES.index(y)], 1e-300)) for x, y in zip(a, b) if x in BASES and y in BASES))


def best_length(f, low: float = 1e-4, high: float = 1.0, steps: int = 40) -> float:
    """Where f, with one peak, is highest: golden section."""
    g = (5**0.5 - 1) / 2
    a, b = low, high
    x, y = b - g * (b - a), a + g * (b - a)
    fx, fy = f(x), f(y)
    for _ in range(steps):
        if fx >= fy:
            b, y, fy = y, x, fx
            x = b - g * (b - a)
            fx = f(x)
        else:
            a, x, fx = x, y, fy
            y = a + g * (b - a)
            fy = f(y)
    return (a + b) / 2


def tree_log_likelihood(tree: Tree, rows: dict[str, str], q: np.ndarray, freqs: np.ndarray | None = None) -> float:
    """Felsenstein's pruning over all columns; what isn't one of ACGT may be any."""
    freqs = np.full(4, 0.25) if freqs is None else freqs
    width = max((len(r) for r in rows.values()), default=0)
    part: dict[int, np.ndarray] = {}
    shift = np.zeros(width)
    for n in sorted(tree, key=lambda n: n["node_id"]):
        if not n["children"]:
            own = np.ones((width, 4))
            for k, c in enumerate(rows[n["name"]]):
                if c in BASES:
                    own[k] = np.eye(4)[BASES.index(c)]
        else:
            own = np.ones((width, 4))
            for c in n["children"]:
                own = own * (part[c] @ probabilities(q, max(tree[c]["branch_length"], 1e-9)).T)
            top = own.max(1, keepdims=True)
            own, shift = own / top, shift + np.log(top[:, 0])
        part[n["node_id"]] = own
    root = next(n["node_id"] for n in tree if n["parent"] is None)
    return float((np.log(part[root] @ freqs) + shift).sum()) if width else 0.0


def optimise_branches(tree: Tree, rows: dict[str, str], q: np.ndarray, rounds: int = 3) -> tuple[Tree, float]:
    """Each branch in turn set where the likelihood is highest, until a round gains nothing."""
    tree = [dict(n) for n in tree]
    best = tree_log_likelihood(tree, rows, q)
    for _ in range(rounds):
        before = best
        for n in tree:
            if n["parent"] is None:
                continue

            def score(t: float) -> float:
                n["branch_length"] = t
                return tree_log_likelihood(tree, rows, q)

            old = n["branch_length"]
            t = best_length(score, steps=20)
            new = score(t)
            n["branch_length"] = t if new > best else old
            best = max(best, new)
        if best - before < 1e-6:
            break
    return tree, best

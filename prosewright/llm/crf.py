"""A linear-chain conditional random field in numpy, on batches of padded sequences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: Padded positions worked on at once.
CELLS = 200_000


@dataclass
class Chain:
    """Emission weights (features x states), transitions and start scores."""

    w: np.ndarray
    trans: np.ndarray
    start: np.ndarray


def batches(lengths: np.ndarray, cells: int = CELLS) -> Iterator[np.ndarray]:
    """Indices of sequences of like length whose padded size stays within ``cells``; one longer sequence goes alone."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * lengths[order[end]] <= cells:
            end += 1
        yield order[at:end]
        at = end


def padded(emissions: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequences, longest, states) and a mask, from rows laid end to end."""
    longest = int(lengths.max())
    mask = np.arange(longest) < lengths[:, None]
    out = np.zeros((len(lengths), longest, emissions.shape[1]))
    out[mask] = emissions[np.concatenate([np.arange(s, s + n) for s, n in zip(starts, lengths, strict=True)])]
    return out, mask


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(e: np.ndarray, mask: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals, the sum of expected transitions, and log partition of each sequence."""
    n, longest, k = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0] + chain.start
    for t in range(1, longest):
        step = _lse(alpha[:, t - 1, :, None] + chain.trans, 1) + e[:, t]
        alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
    log_z = _lse(alpha[:, -1], 1)
    moves = np.zeros((k, k))
    for t in range(longest - 2, -1, -1):
        ahead = chain.trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
        beta[:, t] = np.where(mask[:, t + 1, None], _lse(ahead, 2), beta[:, t])
        pair = np.exp(alpha[:, t, :, None] + ahead - log_z[:, None, None])
        moves += pair[mask[:, t + 1]].sum(axis=0)
    return np.exp(alpha + beta - log_z[:, None, None]), moves, log_z


def viterbi(e: np.ndarray, mask: np.ndarray, chain: Chain) -> np.ndarray:
    """The best path of each sequence; positions of the padding repeat its end."""
    n, longest, k = e.shape
    back = np.zeros((n, longest, k), np.int16)
    score = e[:, 0] + chain.start
    for t in range(1, longest):
        options = score[:, :, None] + chain.trans
        back[:, t] = options.argmax(axis=1)
        new = options.max(axis=1) + e[:, t]
        score = np.where(mask[:, t, None], new, score)
        back[:, t][~mask[:, t]] = np.arange(k)
    path = np.empty((n, longest), np.int16)
    path[:, -1] = score.argmax(axis=1)
    for t in range(longest - 1, 0, -1):
        path[:, t - 1] = np.take_along_axis(back[:, t], path[:, t, None].astype(np.intp), 1)[:, 0]
    return path


def train(x: np.ndarray, y: np.ndarray, lengths: Sequence[int], states: int, steps: int = 60, rate: float = 0.2, l2: float = 1e-3, forbidden: np.ndarray | None = None, n_features: int | None = None) -> Chain:
    """Maximum likelihood by Adam on whole batches. ``forbidden`` transitions keep a large negative score.

    ``x`` has a number for each feature, or with ``n_features`` the indices of the active ones."""
    lengths = np.asarray(lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    params = [np.zeros((n_features or x.shape[1], states)), np.zeros((states, states)), np.zeros(states)]
    seen = np.zeros((states, states))
    same = np.ones(len(y), bool)
    same[starts] = False
    np.add.at(seen, (y[:-1][same[1:]], y[1:][same[1:]]), 1)
    gold = np.zeros((len(y), states))
    gold[np.arange(len(y)), y] = 1
    fixed = np.zeros((states, states)) if forbidden is None else np.where(forbidden, -1e4, 0.0)
    groups = list(batches(lengths))
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        chain = Chain(params[0], params[1] + fixed, params[2])
        emissions, expected, moves = x @ chain.w if n_features is None else chain.w[x].sum(axis=1), np.zeros_like(gold), np.zeros((states, states))
        for g in groups:
            e, mask = padded(emissions, starts[g], lengths[g])
            p, mv, _ = forward_backward(e, mask, chain)
            rows = np.concatenate([np.arange(starts[i], starts[i] + lengths[i]) for i in g])
            expected[rows] = p[mask]
            moves += mv
        diff = gold - expected
        if n_features is None:
            of_x = x.T @ diff
        else:
            of_x = np.zeros_like(params[0])
            np.add.at(of_x, x.ravel(), np.repeat(diff, x.shape[1], axis=0))
        grads = [of_x, seen - moves, diff[starts].sum(axis=0)]
        for i, g in enumerate(grads):
            g = g / len(y) - l2 * params[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Chain(params[0], params[1] + fixed, params[2])

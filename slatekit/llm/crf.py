"""Linear-chain conditional random field over binary features and hashed words,
in numpy."""

from __future__ import annotations

import numpy as np

LABELS = 3          # begin, inside, outside
BEGIN, INSIDE, OUTSIDE = range(LABELS)


class CRF:
    """Emission weights (features x labels), transition weights, and a table of
    emission weights (buckets x labels) for each hashed word; the words' buckets
    are the last columns of the features."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, words: tuple[np.ndarray, ...] = ()):
        self.emit, self.move, self.words = emit, move, words

    def scores(self, feats: np.ndarray) -> np.ndarray:
        n = len(self.emit)
        out = feats[:, :n].astype(np.float32) @ self.emit.astype(np.float32)
        for k, table in enumerate(self.words):
            out += table.astype(np.float32)[feats[:, n + k]]
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(feats: np.ndarray, labels: np.ndarray, length: np.ndarray, steps: int = 150,
          rate: float = 0.1, ridge: float = 1e-3, words: int = 0, buckets: int = 0) -> CRF:
    """Maximum likelihood by Adam.  ``feats`` is windows x time x features,
    padded, the last ``words`` of which are numbers of ``buckets``; ``length`` the
    tokens of each window."""
    n, t, f = feats.shape
    f -= words
    emit, move = np.zeros((f, LABELS)), np.zeros((LABELS, LABELS))
    tables = [np.zeros((buckets, LABELS)) for _ in range(words)]
    on = np.arange(t)[None, :] < length[:, None]
    gold = np.eye(LABELS)[labels] * on[..., None]
    pair_on = on[:, 1:]
    gold_move = np.einsum("nti,ntj->ij", gold[:, :-1] * pair_on[..., None], gold[:, 1:])
    x = feats[..., :f].reshape(n * t, f).astype(np.float64)
    at = [feats[..., f + k].ravel().astype(np.int64) for k in range(words)]
    weights = [emit, move, *tables]
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for step in range(1, steps + 1):
        e = x @ emit
        for table, b in zip(tables, at):
            e += table[b]
        e = e.reshape(n, t, LABELS)
        fwd, bwd = np.empty_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for k in range(1, t):
            new = e[:, k] + _logsum(fwd[:, k - 1, :, None] + move, 1)
            fwd[:, k] = np.where(on[:, k, None], new, fwd[:, k - 1])
        for k in range(t - 2, -1, -1):
            new = _logsum(move + (e[:, k + 1] + bwd[:, k + 1])[:, None, :], 2)
            bwd[:, k] = np.where(on[:, k + 1, None], new, 0.0)
        z = _logsum(fwd[:, -1], 1)
        post = np.exp(fwd + bwd - z[:, None, None]) * on[..., None]
        two = (fwd[:, :-1, :, None] + move + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
        want_move = np.einsum("ntij->ij", np.exp(np.where(pair_on[..., None, None], two, -np.inf)))
        miss = (gold - post).reshape(n * t, LABELS)
        grads = [x.T @ miss / n - ridge * emit, (gold_move - want_move) / n - ridge * move]
        grads += [np.stack([np.bincount(b, miss[:, k], buckets) for k in range(LABELS)], axis=1) / n - ridge * table
                  for table, b in zip(tables, at)]
        for p, g, (m, v) in zip(weights, grads, state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return CRF(emit, move, tuple(tables))


def viterbi(model: CRF, e: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Best labels of tokens with emission scores ``e``; ``chain`` numbers the
    sequence of each token (non-decreasing).

    Where the outside label leads by more than any two transitions can win back,
    the best path is outside; only the stretches between such tokens are
    decoded, all of them step by step together.
    """
    n = len(e)
    out = np.full(n, OUTSIDE, np.int8)
    margin = 2 * (model.move.max() - model.move.min())
    live = e[:, OUTSIDE] - e[:, :OUTSIDE].max(axis=1) <= margin
    at = np.flatnonzero(live)
    if not len(at):
        return out
    new = np.concatenate(([True], (np.diff(at) > 1) | (chain[at[1:]] != chain[at[:-1]])))
    start = at[new]
    length = np.diff(np.concatenate((np.flatnonzero(new), [len(at)])))
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    inner = (start > 0) & (chain[np.maximum(start - 1, 0)] == chain[start])
    best = e[start] + np.where(inner[:, None], model.move[OUTSIDE][None, :], 0.0)
    back: list[np.ndarray] = []
    finals = best.copy()
    for k in range(1, int(length[0])):
        m = int(np.searchsorted(-length, -k, "left"))      # stretches longer than k
        step = finals[:m, :, None] + model.move
        back.append(step.argmax(axis=1).astype(np.int8))
        finals[:m] = step.max(axis=1) + e[start[:m] + k]
    end = start + length - 1
    goes_on = (end + 1 < n) & (chain[np.minimum(end + 1, n - 1)] == chain[end])
    label = (finals + np.where(goes_on[:, None], model.move[:, OUTSIDE][None, :], 0.0)).argmax(axis=1)
    for k in range(int(length[0]) - 1, -1, -1):
        m = int(np.searchsorted(-length, -k, "left"))
        out[start[:m] + k] = label[:m]
        if k:
            label[:m] = back[k - 1][np.arange(m), label[:m]]
    return out

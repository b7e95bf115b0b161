"""Linear-chain conditional random field in numpy: training by Adam on the exact likelihood, batched Viterbi."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Feature names of one position.
Features = Sequence[str]


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@dataclass(eq=False)
class Crf:
    labels: list[str]
    index: dict[str, int]
    #: features x labels; labels x labels; labels of first positions
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def emissions(self, sequence: Sequence[Features]) -> np.ndarray:
        out = np.zeros((len(sequence), len(self.labels)))
        index, weights = self.index, self.weights
        for k, names in enumerate(sequence):
            if known := [index[f] for f in names if f in index]:
                out[k] = weights[known].sum(axis=0)
        return out

    def decode(self, sequences: Sequence[Sequence[Features]]) -> list[np.ndarray]:
        """Best label numbers of each sequence; ties go to the lower number."""
        return viterbi([self.emissions(s) for s in sequences], self.moves, self.first)


def viterbi(scores: list[np.ndarray], moves: np.ndarray, first: np.ndarray, batch: int = 512) -> list[np.ndarray]:
    """Viterbi over batches of sequences of like length, all of a batch step by step at once."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    order = sorted((k for k in range(len(scores)) if len(scores[k])), key=lambda k: len(scores[k]))
    at = 0
    while at < len(order):
        longest = max(32, 2 * len(scores[order[at]]))
        group = [k for k in order[at : at + batch] if len(scores[k]) <= longest]
        at += len(group)
        sizes = np.array([len(scores[k]) for k in group])
        steps, n = int(sizes.max()), len(first)
        padded = np.zeros((steps, len(group), n))
        for i, k in enumerate(group):
            padded[: sizes[i], i] = scores[k]
        back = np.zeros((steps, len(group), n), np.int8)
        best = padded[0] + first
        for t in range(1, steps):
            through = best[:, :, None] + moves
            back[t] = through.argmax(axis=1)
            best = np.where((t < sizes)[:, None], through.max(axis=1) + padded[t], best)
        rows, state = np.arange(len(group)), best.argmax(axis=1)
        path = np.zeros((steps, len(group)), np.int64)
        for t in range(steps - 1, -1, -1):
            path[t] = state
            state = np.where((t > 0) & (t < sizes), back[t, rows, state], state)
        for i, k in enumerate(group):
            out[k] = path[: sizes[i], i]
    return out


def train(sequences: Sequence[Sequence[Features]], tags: Sequence[Sequence[str]], labels: list[str], steps: int = 100, rate: float = 0.1, ridge: float = 0.02) -> Crf:
    """Maximises the penalised likelihood of labelled sequences; always the same for the same input."""
    index: dict[str, int] = {}
    for s in sequences:
        for names in s:
            for f in names:
                index.setdefault(f, len(index))
    n, size = len(labels), [len(s) for s in sequences]
    steps_most = max(size)
    # One flat table of (position, feature), and gold labels.
    where, feature = [], []
    gold = np.full((len(sequences), steps_most), -1)
    for k, s in enumerate(sequences):
        gold[k, : size[k]] = [labels.index(t) for t in tags[k]]
        for t, names in enumerate(s):
            for f in names:
                where.append(k * steps_most + t), feature.append(index[f])
    where, feature, inside = np.array(where), np.array(feature), gold >= 0
    parts = [np.zeros((len(index), n)), np.zeros((n, n)), np.zeros(n)]
    mean, var = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    hot = np.eye(n)[np.maximum(gold, 0)] * inside[:, :, None]
    for step in range(1, steps + 1):
        weights, moves, first = parts
        score = np.zeros((len(sequences) * steps_most, n))
        np.add.at(score, where, weights[feature])
        score = score.reshape(len(sequences), steps_most, n)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + first
        for t in range(1, steps_most):
            ahead[:, t] = np.where(inside[:, t, None], _logsumexp(ahead[:, t - 1, :, None] + moves, 1) + score[:, t], ahead[:, t - 1])
        total = _logsumexp(ahead[:, -1], 1)
        for t in range(steps_most - 2, -1, -1):
            behind[:, t] = np.where(inside[:, t + 1, None], _logsumexp(moves + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0.0)
        chance = np.exp(ahead + behind - total[:, None, None]) * inside[:, :, None]
        miss = (hot - chance).reshape(-1, n)
        grads = [np.zeros_like(weights), np.zeros_like(moves), (hot[:, 0] - chance[:, 0]).sum(axis=0)]
        np.add.at(grads[0], feature, miss[where])
        for t in range(1, steps_most):
            both = np.exp(ahead[:, t - 1, :, None] + moves + (score[:, t] + behind[:, t])[:, None, :] - total[:, None, None]) * inside[:, t, None, None]
            grads[1] += (hot[:, t - 1, :, None] * hot[:, t, None, :] - both).sum(axis=0)
        for k, g in enumerate(grads):
            g = g / len(sequences) - ridge * parts[k] / 10
            mean[k] = 0.9 * mean[k] + 0.1 * g
            var[k] = 0.999 * var[k] + 0.001 * g * g
            parts[k] = parts[k] + rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    return Crf(labels, index, *parts)

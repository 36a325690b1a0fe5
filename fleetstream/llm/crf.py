"""Linear-chain conditional random field over sequences of binary features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Sequences:
    """Steps of all sequences one after the other.

    ``features`` and ``step`` are parallel: feature ``features[i]`` is on in
    step ``step[i]``, steps in rising order. ``lengths``: steps of each sequence.
    """

    features: np.ndarray
    step: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, sequences: list[list[list[int]]]) -> Sequences:
        steps = [f for s in sequences for f in s]
        counts = np.array([len(f) for f in steps], dtype=np.int64)
        flat = np.fromiter((x for f in steps for x in f), dtype=np.int64, count=int(counts.sum()))
        return cls(flat, np.repeat(np.arange(len(steps)), counts), np.array([len(s) for s in sequences], dtype=np.int64))


class ChainCrf:
    """Labels 0..labels-1; ``weights`` (features, labels), ``moves`` (labels, labels), ``first`` (labels)."""

    def __init__(self, features: int, labels: int = 2):
        self.weights = np.zeros((features, labels))
        self.moves, self.first = np.zeros((labels, labels)), np.zeros(labels)

    def scores(self, data: Sequences) -> np.ndarray:
        n, labels = int(data.lengths.sum()), self.weights.shape[1]
        return np.stack([np.bincount(data.step, weights=self.weights[data.features, k], minlength=n) for k in range(labels)], axis=1) if n else np.zeros((0, labels))

    @staticmethod
    def _waves(lengths: np.ndarray):
        """Longest first: for each place t, the steps of all sequences that have a place t (a prefix of the order)."""
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        sizes = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
        return [starts[:k] + t for t, k in enumerate(sizes)]

    def decode(self, data: Sequences) -> np.ndarray:
        """Viterbi: the best label of each step; ties go to the smaller label."""
        scores, waves = self.scores(data), self._waves(data.lengths)
        out = np.zeros(len(scores), dtype=np.int64)
        if not waves:
            return out
        back = np.zeros(scores.shape, dtype=np.int64)
        best = scores.copy()
        best[waves[0]] += self.first
        for before, now in zip(waves, waves[1:], strict=False):
            ways = best[before[: len(now)]][:, :, None] + self.moves
            back[now] = ways.argmax(axis=1)
            best[now] += ways.max(axis=1)
        for t in range(len(waves) - 1, -1, -1):
            going_on = len(waves[t + 1]) if t + 1 < len(waves) else 0
            ends = waves[t][going_on:]
            out[ends] = best[ends].argmax(axis=1)
            if going_on:
                after = waves[t + 1]
                out[waves[t][:going_on]] = back[after, out[after]]
        return out

    def gradient(self, data: Sequences, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood of the labels, and its gradient by weights, moves and first, by forward-backward."""
        scores, waves = self.scores(data), self._waves(data.lengths)
        forward, behind = scores.copy(), np.zeros_like(scores)
        forward[waves[0]] += self.first
        for before, now in zip(waves, waves[1:], strict=False):
            forward[now] += np.logaddexp.reduce(forward[before[: len(now)]][:, :, None] + self.moves, axis=1)
        total = np.zeros(len(scores))
        pairs = np.zeros_like(self.moves)
        for t in range(len(waves) - 1, -1, -1):
            now = waves[t]
            going_on = len(waves[t + 1]) if t + 1 < len(waves) else 0
            ends = now[going_on:]
            total[ends] = np.logaddexp.reduce(forward[ends], axis=1)
            if going_on:
                after, here = waves[t + 1], now[:going_on]
                ways = self.moves + (scores[after] + behind[after])[:, None, :]
                behind[here] = np.logaddexp.reduce(ways, axis=2)
                total[here] = total[after]
                pairs += np.exp(forward[here][:, :, None] + ways - total[here][:, None, None]).sum(axis=0)
        chance = np.exp(forward + behind - total[:, None])
        labels = scores.shape[1]
        miss = np.eye(labels)[gold] - chance
        by_weight = np.stack([np.bincount(data.features, weights=miss[data.step, k], minlength=len(self.weights)) for k in range(labels)], axis=1)
        seen, value = np.zeros_like(self.moves), 0.0
        for before, now in zip(waves, waves[1:], strict=False):
            np.add.at(seen, (gold[before[: len(now)]], gold[now]), 1)
        value = scores[np.arange(len(gold)), gold].sum() + self.first[gold[waves[0]]].sum() + (seen * self.moves).sum() - total[waves[0]].sum()
        return float(value), by_weight, seen - pairs, miss[waves[0]].sum(axis=0)

    def fit(self, data: Sequences, gold: np.ndarray, rounds: int = 120, rate: float = 0.1, penalty: float = 1.0) -> ChainCrf:
        """Maximum likelihood with a quadratic penalty, by full gradients and Adam; no randomness. Without steps the weights stay 0."""
        if not len(gold):
            return self
        parts = [self.weights, self.moves, self.first]
        mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        for r in range(1, rounds + 1):
            _, *slopes = self.gradient(data, gold)
            for p, g, m, v in zip(parts, slopes, mean, square, strict=True):
                g = (g - penalty * p) / len(gold)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
        return self

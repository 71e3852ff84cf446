"""An averaged perceptron over string features, small enough to train on the driver and to ship with a task."""

from __future__ import annotations

import random
from collections import defaultdict


class Perceptron:
    def __init__(self, weights: dict[str, dict[str, float]] | None = None, labels: list[str] | None = None):
        self.weights = weights or {}
        self.labels = labels or []

    def scores(self, features: list[str]) -> dict[str, float]:
        out = dict.fromkeys(self.labels, 0.0)
        for f in features:
            w = self.weights.get(f)
            if w:
                for label, x in w.items():
                    out[label] += x
        return out

    def best(self, features: list[str]) -> str:
        s = self.scores(features)
        return max(self.labels, key=lambda label: (s[label], label))

    def train(self, examples: list[tuple[list[str], str]], rounds: int = 5, seed: int = 7) -> Perceptron:
        """Averaged weights after ``rounds`` passes; the same examples give the same weights."""
        self.labels = sorted({y for _, y in examples})
        totals: dict[tuple[str, str], float] = defaultdict(float)
        stamps: dict[tuple[str, str], int] = defaultdict(int)
        weights: dict[str, dict[str, float]] = {}
        self.weights = weights
        now, order = 0, list(range(len(examples)))
        rng = random.Random(seed)

        def move(f: str, label: str, by: float) -> None:
            w = weights.setdefault(f, {})
            key = (f, label)
            totals[key] += (now - stamps[key]) * w.get(label, 0.0)
            stamps[key] = now
            w[label] = w.get(label, 0.0) + by

        for _ in range(rounds):
            rng.shuffle(order)
            for k in order:
                features, truth = examples[k]
                now += 1
                guess = self.best(features)
                if guess != truth:
                    for f in features:
                        move(f, truth, 1.0)
                        move(f, guess, -1.0)
        for f, w in weights.items():
            for label in list(w):
                key = (f, label)
                w[label] = (totals[key] + (now - stamps[key]) * w[label]) / max(now, 1)
        self.weights = {f: kept for f, w in weights.items() if (kept := {y: x for y, x in w.items() if abs(x) > 1e-6})}
        return self


class Ranker:
    """An averaged perceptron that chooses among candidates, each a list of features; the first candidate stands if no other scores above it."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def choose(self, candidates: list[list[str]]) -> int:
        best, at = self.score(candidates[0]), 0
        for k, features in enumerate(candidates[1:], 1):
            s = self.score(features)
            if s > best:
                best, at = s, k
        return at

    def train(self, examples: list[tuple[list[list[str]], int]], rounds: int = 5, seed: int = 7) -> Ranker:
        """Averaged weights after ``rounds`` passes; the same examples give the same weights."""
        self.weights, now = {}, 0
        totals: dict[str, float] = defaultdict(float)
        order, rng = list(range(len(examples))), random.Random(seed)
        for _ in range(rounds):
            rng.shuffle(order)
            for k in order:
                candidates, truth = examples[k]
                now += 1
                guess = self.choose(candidates)
                if guess != truth:
                    for by, which in ((1.0, truth), (-1.0, guess)):
                        for f in candidates[which]:
                            self.weights[f] = self.weights.get(f, 0.0) + by
                            totals[f] += by * now
        # The mean of the weights over all steps: each move counts from the step at which it was made.
        last = now + 1
        self.weights = {f: x for f, w in self.weights.items() if abs(x := w - totals[f] / last) > 1e-6}
        return self

"""Skip-gram vectors with negative sampling, fitted to co-occurrence counts.

The counts of (word, context) over the whole corpus hold all that the skip-gram objective takes from
the text, so the text is read once in a distributed pass and the fit runs on a matrix of bounded size.
"""

from __future__ import annotations

import numpy as np


def fit(counts: np.ndarray, size: int = 24, negatives: float = 5.0, rounds: int = 80, rate: float = 0.08, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(word vectors, context vectors) that maximise the skip-gram objective for a (words, contexts) count matrix."""
    words, contexts = counts.shape
    rng = np.random.default_rng(seed)
    u = rng.normal(0, 0.1, (words, size)).astype(np.float32)
    v = rng.normal(0, 0.1, (contexts, size)).astype(np.float32)
    total = max(1.0, float(counts.sum()))
    positive = counts.astype(np.float32)
    share = (counts.sum(0) / total).astype(np.float32)
    negative = negatives * counts.sum(1, keepdims=True).astype(np.float32) * share[None, :]
    # Frequent words count less than in proportion, as subsampling would have it.
    scale = 1 / np.maximum(positive.sum(1, keepdims=True), 1) ** 0.5
    positive, negative = positive * scale, negative * scale
    moments = [np.zeros_like(x) for x in (u, u, v, v)]
    for step in range(1, rounds + 1):
        s = 1 / (1 + np.exp(-np.clip(u @ v.T, -15, 15)))
        g = positive * (1 - s) - negative * s
        for x, grad, m, q in ((u, g @ v, moments[0], moments[1]), (v, g.T @ u, moments[2], moments[3])):
            m *= 0.9
            m += 0.1 * grad
            q *= 0.99
            q += 0.01 * grad * grad
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-6)
    return u, v

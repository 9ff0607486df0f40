"""Random permutations of 0 .. N-1 of which any task can compute any part, without holding the rest."""

import numpy as np

ROUNDS = 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(places: np.ndarray, total: int, *key: int) -> np.ndarray:
    """Where the permutation named by key (a seed and a number, say) puts each of places, all below total.

    A Feistel network permutes the next power of four; a place that it puts at or beyond total goes through it again until
    it falls below, which keeps it a permutation. At most four times as many places as there are take part, so
    two or three runs are the rule.
    """
    half = np.uint64(max(1, -(-(max(total, 2) - 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.default_rng(key).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)
    out, open_ = np.array(places, np.uint64), np.arange(len(places))
    while len(open_):
        left, right = out[open_] >> half, out[open_] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & mask)
        out[open_] = left << half | right
        open_ = open_[out[open_] >= total]
    return out.astype(np.int64)

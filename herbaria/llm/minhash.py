"""One-permutation MinHash: bin shingle hashes once, densify, compare bin by bin."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from herbaria.llm.common import mix64

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@lru_cache(8)
def _draws(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Draw order of every bin: row i lists the bins that bin i draws, and at which turn it draws each."""
    at = np.arange(bins * bins, dtype=np.uint64)
    drawn = np.argsort(mix64(at, 977).reshape(bins, bins), axis=1, kind="stable")
    return drawn, drawn.argsort(axis=1).astype(np.uint16)


def densify(values: np.ndarray) -> np.ndarray:
    """Fill empty bins by optimal densification.

    Each empty bin draws bins in its own fixed random order until it meets one
    that was filled by binning, and takes that value; so two sets agree in a
    filled bin with the chance of their Jaccard similarity. Rows without any
    value stay empty.
    """
    filled = values != EMPTY
    drawn, turns = _draws(values.shape[1])
    some = np.flatnonzero(~filled.all(axis=1) & filled.any(axis=1))
    out = values.copy()
    if values.shape[1] <= 64:
        for at in range(0, len(some), 512):
            rows = some[at:at + 512]
            turn = np.where(filled[rows][:, None, :], turns[None], np.uint16(0xFFFF))
            full = np.take_along_axis(values[rows], turn.argmin(axis=2), axis=1)
            out[rows] = np.where(filled[rows], values[rows], full)
    else:
        for r in some:
            full, empty = np.flatnonzero(filled[r]), np.flatnonzero(~filled[r])
            for turn in range(10 if len(full) > 64 else 0):
                source = drawn[empty, turn]
                hit = filled[r, source]
                out[r, empty[hit]] = values[r, source[hit]]
                empty = empty[~hit]
                if not len(empty):
                    break
            if len(empty):
                out[r, empty] = values[r, full[turns[empty][:, full].argmin(axis=1)]]
    return out


def one_permutation(hashes: np.ndarray, owner: np.ndarray, n: int, bins: int) -> np.ndarray:
    """Smallest hash of each bin for ``n`` sets, densified; ``owner`` gives each hash's set.

    The bin is taken from the upper half of a hash, and the values are compared
    by their lower half first, so bin and order are independent.
    """
    out = np.full((n, bins), EMPTY)
    slot = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(out.reshape(-1), owner * bins + slot, hashes << np.uint64(32) | hashes >> np.uint64(32))
    return densify(out)

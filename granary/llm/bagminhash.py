"""BagMinHash signatures of weighted sets.  NumPy only.

Each element has a Poisson process over the plane of time and weight.  The weights are cut at 0, 1, 2, 4,
8 and so on; an interval that lies below the element's weight counts whole, and in the one that contains
it a point counts if it falls below the weight.  A point is dealt to one of the registers, and each
register keeps its earliest point.  Two sets agree in a register with the probability of their weighted
Jaccard similarity.  An interval's points come in the order of time, so it is left as soon as all
registers of its set hold earlier points.
"""

from __future__ import annotations

import numpy as np

from granary.llm.tokens import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _unit(h: np.ndarray) -> np.ndarray:
    """(0, 1) from the upper 53 bits."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(sets: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_sets: int, registers: int) -> np.ndarray:
    """An array of ``n_sets`` x ``registers`` times; registers of a set without elements are infinite.

    ``sets`` numbers the set of each (distinct) element, ``elements`` are 64-bit hashes and ``weights``
    whole numbers from 1.  Equal times stand for the same point.
    """
    best = np.full(n_sets * registers, np.inf)
    latest = np.full(n_sets, np.inf)
    low, width = 0, 1
    while True:
        inside = np.flatnonzero(weights > low)
        if not len(inside):
            break
        owner, limit = sets[inside].astype(np.int64), weights[inside]
        state = mix(elements[inside] ^ mix(np.array([low + 1], np.uint64)))
        time = np.zeros(len(inside))
        while len(owner):
            state = state + _STEP
            first = mix(state)
            time = time - np.log(_unit(first)) / width
            early = time < latest[owner]
            if not early.all():
                owner, limit, state, time, first = owner[early], limit[early], state[early], time[early], first[early]
            second = mix(first ^ _STEP)
            slot = owner * registers + ((second & np.uint64(0xFFFFFFFF)) % np.uint64(registers)).astype(np.int64)
            # The upper half of the hash is the point's weight within the interval.
            good = time < best[slot]
            if width > 1:
                good &= low + (second >> np.uint64(32)).astype(np.float64) * 2.0**-32 * width < limit
            if good.any():
                np.minimum.at(best, slot[good], time[good])
                touched = np.unique(owner[good])
                latest[touched] = best.reshape(n_sets, registers)[touched].max(axis=1)
        low, width = low + width, max(low + width, 1)
    return best.reshape(n_sets, registers)


def bags(owner: np.ndarray, hashes: np.ndarray, n_sets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, element, count) of the distinct elements; ``owner`` must not fall.  Elements keep 44 bits."""
    step = 1 << 20
    out = []
    for base in range(0, max(n_sets, 1), step):
        a, b = np.searchsorted(owner, [base, base + step])
        keys = np.sort((owner[a:b] - base).astype(np.uint64) << np.uint64(44) | hashes[a:b] >> np.uint64(20))
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        out.append(((keys[new] >> np.uint64(44)).astype(np.int64) + base, keys[new] & np.uint64((1 << 44) - 1), np.diff(np.r_[new, len(keys)])))
    return tuple(np.concatenate(x) for x in zip(*out))


def band_keys(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each set and band."""
    bits = np.ascontiguousarray(times).view(np.uint64)
    keys = np.empty((len(times), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(times), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * _STEP + bits[:, b * rows + r])
        keys[:, b] = h
    return keys


def short(times: np.ndarray) -> np.ndarray:
    """One byte for each register; unequal points agree in one case of 256."""
    return (mix(np.ascontiguousarray(times).view(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets of hashes: the sum of the smaller counts over the sum of the larger ones; 1 for two empty ones."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    every = len(a) + len(b) - both
    return both / every if every else 1.0

"""DartMinHash: signatures of weighted sets from darts thrown at their elements.

Every element owns a half plane of (weight, rank) on which a hash has thrown darts, one per
unit of area on average; each dart also names a coordinate.  A set sees the darts below the
weights of its elements; coordinate c of its signature is the least rank among those that name
c.  Two sets agree in a coordinate with the probability of their weighted Jaccard similarity.
Only ranks up to a limit need be looked at: it is set so that about k (ln k + 5) darts are
seen, and doubled for the few sets that have a coordinate without any.
"""

from __future__ import annotations

import numpy as np

from klaxon.llm.words import U, mix, within

FRACTION_BITS = 40
EMPTY = np.uint64(2**64 - 1)
# Upper ends of the Poisson(1) distribution by the number of darts in a unit cell.
POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, n + 1)) for n in range(16)])


def unit(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)).astype(np.float64) * 2.0**-53


def throw(
    elements: np.ndarray, weights: np.ndarray, row: np.ndarray, limit: np.ndarray, out: np.ndarray, floor: np.ndarray
) -> None:
    """Lower out[row, coordinate] by the darts of each element with floor <= rank < limit of its row."""
    rows, k = out.shape
    high, wide = np.ceil(limit).astype(np.int64)[row], np.ceil(weights).astype(np.int64)
    low = np.floor(floor).astype(np.int64)[row]
    number = (high - low) * wide
    owner = np.repeat(np.arange(len(elements)), number)
    cell = within(number)
    level, place = cell // wide[owner] + low[owner], cell % wide[owner]
    seed = mix(elements[owner] + U(0x9E3779B97F4A7C15) * (level.astype(U) * U(0x100000001) + place.astype(U)))
    darts = np.searchsorted(POISSON, unit(seed), side="right")
    which = np.repeat(np.arange(len(seed)), darts)
    h = mix(seed[which] ^ mix(within(darts).astype(U) + U(1)))
    owner, level, place = owner[which], level[which], place[which]
    fraction = h >> U(64 - FRACTION_BITS)
    rank = level + fraction.astype(np.float64) * 2.0**-FRACTION_BITS
    h = mix(h)
    seen = (rank < limit[row[owner]]) & (rank >= floor[row[owner]])
    seen &= place + unit(h) < weights[owner]
    coordinate = (mix(h[seen]) % U(k)).astype(np.int64)
    value = (level[seen].astype(U) << U(FRACTION_BITS)) | fraction[seen]
    np.minimum.at(out.reshape(-1), row[owner[seen]] * k + coordinate, value)


def signatures(elements: np.ndarray, weights: np.ndarray, per_row: np.ndarray, k: int) -> np.ndarray:
    """One row of k ranks per set; a set without elements has EMPTY in all."""
    rows = len(per_row)
    out = np.full((rows, k), EMPTY)
    row = np.repeat(np.arange(rows), per_row)
    total = np.bincount(row, weights, rows)
    limit = np.where(total > 0, k * (np.log(k) + 5) / np.maximum(total, 1e-300), 0)
    floor = np.zeros(rows)
    active = total > 0
    while active.any():
        mine = active[row]
        throw(elements[mine], weights[mine], row[mine], np.where(active, limit, 0), out, np.where(active, floor, 0))
        active = active & (out == EMPTY).any(axis=1)
        floor, limit = np.where(active, limit, floor), np.where(active, 2 * limit, limit)
    return out

"""Words of a batch of texts as numpy arrays: spans, hashes and n-grams, without a Python loop."""

from __future__ import annotations

import functools

import numpy as np

# Byte classes.  White space is ASCII; every byte of a letter beyond ASCII counts as a letter.
SPACE, LETTER, OTHER = 0, 1, 2

U = np.uint64


def byte_classes(marks: bool) -> np.ndarray:
    """Class of each byte; with `marks` runs of signs are words of their own."""
    classes = np.full(256, OTHER if marks else LETTER, np.uint8)
    classes[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = SPACE
    if marks:
        classes[0x30:0x3A] = classes[0x41:0x5B] = classes[0x61:0x7B] = classes[0x80:] = LETTER
    return classes


PLAIN, MARKED = byte_classes(False), byte_classes(True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


@functools.lru_cache(maxsize=4)
def letter_codes(fold: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
    if fold:
        codes[0x41:0x5B] = codes[0x61:0x7B]
    return codes


BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 2**64)


@functools.lru_cache(maxsize=2)
def powers(base: int, size: int) -> np.ndarray:
    found = np.full(size, base, U)
    found[0] = 1
    return np.multiply.accumulate(found)


def powers_to(base: int, n: int) -> np.ndarray:
    return powers(base, 1 << max(22, int(n).bit_length()))[:n]


def spans(ends: np.ndarray, body: np.ndarray, classes: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, words per row) of the runs of one class; no run crosses a row."""
    kinds = classes[body]
    n = len(body)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends) - 1, np.int64)
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:n])
    change[ends] = True
    edges = np.flatnonzero(change)
    starts, stops = edges[:-1], edges[1:]
    real = kinds[starts] != SPACE
    starts, stops = starts[real], stops[real]
    return starts, stops, np.diff(np.searchsorted(starts, ends))


def hashes(body: np.ndarray, starts: np.ndarray, stops: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each span's bytes; with `fold` A-Z count as a-z."""
    sums = np.zeros(len(body) + 1, U)
    np.cumsum(letter_codes(fold)[body] * powers_to(BASE, len(body)), out=sums[1:])
    raw = (sums[stops] - sums[starts]) * powers_to(INVERSE, len(body) + 1)[starts]
    return mix(raw ^ (stops - starts).astype(U))


def shingles(words: np.ndarray, per_row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number per row) of `width` words in a row; a shorter row that has words is one shingle."""
    if not len(words):
        return words, per_row
    length = np.minimum(per_row, width)
    number = np.where(per_row > 0, per_row - length + 1, 0)
    first = np.repeat(np.cumsum(per_row) - per_row, number) + within(number)
    sums = np.zeros(len(words) + 1, U)
    np.cumsum(words * powers_to(BASE, len(words)), out=sums[1:])
    length = np.repeat(length, number)
    raw = (sums[first + length] - sums[first]) * powers_to(INVERSE, len(words) + 1)[first]
    return mix(raw + length.astype(U)), number


def within(number: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... inside each of the groups whose sizes are given."""
    total = int(number.sum())
    return np.arange(total) - np.repeat(np.cumsum(number) - number, number)


def row_sums(values: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """Sum of each group; 0 for an empty one."""
    rows = np.repeat(np.arange(len(per_row)), per_row)
    return np.bincount(rows, values, len(per_row))

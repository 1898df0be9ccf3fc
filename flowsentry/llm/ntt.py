"""Exact integer correlation of many short sequences at once: a number-theoretic transform modulo 65537.

A transform of N = rows x columns (each at most 256) is two products with transform matrices and one with powers of
the root in between. Whole numbers below 2^17 are multiplied and at most 256 products added, so double precision holds
every value exactly and the work runs in matrix products. Transformed values stay in the order that the two steps
leave them in: only products and the way back follow.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

PRIME, GENERATOR = 65537, 3
LONGEST = 1 << 16


def _powers(base: int, count: int) -> np.ndarray:
    out = np.empty(count, np.int64)
    value = 1
    for i in range(count):
        out[i] = value
        value = value * base % PRIME
    return out


def _table(root: int, order: int, left: int, right: int) -> np.ndarray:
    """root^(i * j) for i < left, j < right; `root` has this order."""
    exponent = np.outer(np.arange(left, dtype=np.int64), np.arange(right, dtype=np.int64)) % order
    return _powers(root, order)[exponent].astype(np.float64)


@lru_cache(maxsize=64)
def _tables(size: int, backwards: bool):
    rows = 1 << (size.bit_length() - 1) // 2
    columns = size // rows
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    if backwards:
        root = pow(root, PRIME - 2, PRIME)
    return (rows, columns, _table(pow(root, columns, PRIME), rows, rows, rows),
            _table(pow(root, rows, PRIME), columns, columns, columns), _table(root, size, rows, columns))


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, up to one multiple of it that rounding may leave."""
    return x - np.floor(x * (1.0 / PRIME)) * PRIME


def transform(x: np.ndarray, backwards: bool = False) -> np.ndarray:
    """(many, size) sequences to (many, rows, columns) values, with the root or with its inverse."""
    rows, columns, first, second, twiddle = _tables(x.shape[1], backwards)
    inner = reduced(np.matmul(first, x.reshape(len(x), rows, columns)))
    inner = reduced(inner * twiddle)
    return reduced(np.matmul(inner.reshape(-1, columns), second)).reshape(len(x), rows, columns)


def restored(z: np.ndarray) -> np.ndarray:
    """The (many, size) sequences of transformed values."""
    many, rows, columns = z.shape
    size = rows * columns
    _, _, first, second, twiddle = _tables(size, True)
    inner = reduced(np.matmul(z.reshape(-1, columns), second)).reshape(z.shape)
    inner = reduced(inner * twiddle)
    return reduced(reduced(np.matmul(first, inner)).reshape(many, size) * pow(size, PRIME - 2, PRIME))


def matches(blocks: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shift) where a block equals its row's window from that shift on.

    Values are whole numbers whose squared differences add up to less than the prime over a block; the sum of squared
    differences, x^2 + y^2 - 2xy, is then 0 modulo the prime only if it is 0.
    """
    size, width = windows.shape[1], blocks.shape[1]
    padded = np.zeros(windows.shape)
    padded[:, :width] = blocks
    both = restored(reduced(transform(padded, backwards=True) * transform(windows)))
    shifts = size - width + 1
    running = np.zeros((len(windows), size + 1))
    np.cumsum(windows * windows, axis=1, out=running[:, 1:])
    squares = running[:, width:] - running[:, :shifts] + (blocks * blocks).sum(axis=1, keepdims=True)
    left = np.abs(reduced(squares - 2 * both[:, :shifts]))
    return np.nonzero((left == 0) | (left == PRIME))

"""The binary Golay code (23, 12, 7), built from its generator polynomial."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Fixed value: generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the perfect binary Golay code.
GENERATOR = 0b101011100011
BITS, DATA = 23, 12
CHECKS = BITS - DATA


def _remainder(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64).copy()
    for bit in range(BITS - 1, CHECKS - 1, -1):
        v ^= np.where((v >> bit) & 1, GENERATOR << (bit - CHECKS), 0)
    return v


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and high 11 bits, and the error pattern of each remainder."""
    low, high = _remainder(np.arange(1 << 12)), _remainder(np.arange(1 << 11) << 12)
    bit = 1 << np.arange(BITS)
    none = np.zeros(1, np.int64)
    two = (bit[:, None] ^ bit)[np.triu_indices(BITS, 1)]
    three = np.unique((two[:, None] ^ bit).ravel())
    three = three[np.bitwise_count(three) == 3]
    errors = np.concatenate([none, bit, two, three])
    table = np.zeros(1 << CHECKS, np.int64)
    table[_remainder(errors)] = errors  # the code is perfect: each remainder has one pattern
    return low, high, table


def decode(v: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword within three bits of each 23-bit vector."""
    low, high, errors = _tables()
    return (v ^ errors[low[v & 0xFFF] ^ high[v >> 12]]) >> CHECKS


def near_indices(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (n, 24) of the codewords of each vector and its neighbours, and which are new.

    A vector has one or six different indices. Vectors at most two bits apart share one: some
    vector lies within a bit of both.
    """
    near = np.concatenate([v[:, None], v[:, None] ^ (1 << np.arange(BITS))], axis=1)
    got = np.sort(decode(near), axis=1)
    new = np.ones(got.shape, bool)
    new[:, 1:] = got[:, 1:] != got[:, :-1]
    return got, new

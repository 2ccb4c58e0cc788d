"""Arrays of arrays in numpy: flat values with offsets."""

from __future__ import annotations

import numpy as np


def offsets(lengths: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(lengths, dtype=np.int64)]


def gather(flat: np.ndarray, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of pieces ``codes`` one after another, and each piece's length; ``at`` are offsets in flat."""
    lengths = np.diff(at)[codes]
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0], lengths
    index = np.arange(ends[-1])
    index += np.repeat(at[codes] - (ends - lengths), lengths)
    return flat[index], lengths


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each piece, 0 for empty ones; each is added by itself, so none loses digits to the others."""
    out = np.zeros(len(at) - 1, values.dtype)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = np.add.reduceat(values, at[some])
    return out


def rising(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signed 64-bit keys in ascending order, and their places.

    Where key and place fit into one number, these numbers are sorted: that takes a fraction of the time of sorting places.
    """
    bits = len(keys).bit_length()
    if len(keys) and int(keys.min()) >= 0 and int(keys.max()) < 1 << (63 - bits):
        both = keys << bits
        both |= np.arange(len(keys))
        both.sort()
        order = both & ((1 << bits) - 1)
        both >>= bits
        return both, order
    order = np.argsort(keys, kind="stable")
    return keys[order], order


def changes(keys: np.ndarray) -> np.ndarray:
    """Does a key differ from the one before it? The first does."""
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return new


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in ascending order, the first place of each, and every key's number among them."""
    found, order = rising(keys)
    new = changes(found)
    code = np.empty(len(found), np.int64)
    code[order] = np.cumsum(new) - 1
    return found[new], order[new], code


def paired(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One key for each pair of numbers, neither of them negative, that rises by ``high`` and then ``low``.

    Where a place beside the key would leave no room, ``low`` goes by its number among the distinct ones, and
    ``high`` too if need be.
    """
    room = 63 - len(high).bit_length()
    if len(high) and int(high.max()).bit_length() + int(low.max()).bit_length() > room:
        low = numbered(low)[2]
        if int(high.max()).bit_length() + int(low.max()).bit_length() > room:
            high = numbered(high)[2]
    return high << int(low.max(initial=0)).bit_length() | low


def ordered(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """An order by ``high`` and then ``low``, neither of them negative."""
    return rising(paired(high, low))[1]


def steps(values: np.ndarray) -> np.ndarray:
    """The first value, then each one's difference from the one before it."""
    out = values.copy()
    out[1:] -= values[:-1]
    return out

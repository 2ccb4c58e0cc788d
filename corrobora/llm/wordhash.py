"""Vectorised tokenising and hashing of whole texts with numpy.

A word is a maximal run of bytes other than space and \\x09-\\x0D, with A-Z lowered. Words of up to seven bytes are
told apart by their bytes themselves: length and bytes go through a bijection of 63 bits, so no two of them have one
hash. Longer ones have the first 63 bits of their BLAKE2b digest, made once for each distinct word that a worker
meets. The last bit tells the two kinds apart. So two words get one hash only if two digests of 63 bits are equal,
which nobody can bring about short of trying some 2^32 long words, and which among 10^9 of them happens with a
probability of about one in twenty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Texts are hashed in pieces of about this many bytes, so that a very long text needs no more memory.
PIECE = 1 << 17
#: Words of more bytes are hashed by their digest; digests that a worker remembers.
SHORT_WORD, KNOWN = 7, 1 << 16
GRAM, OTHER_GRAM = U(0xD6E8FEB86659FD93), U(0x9E3779B97F4A7C15)
LOW = U((1 << 63) - 1)
SPACE = re.compile(rb"[\x20\x09-\x0D]")
IS_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: Keeps the first k bytes of eight.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Digests(dict):
    """Long words to their hashes, made on first sight; emptied when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        number = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") | 1
        return number


digests = _Digests()


def _mix63(x: np.ndarray) -> np.ndarray:
    """A bijection of 63 bits: every step can be undone."""
    x = x ^ (x >> U(31))
    x *= U(0xBF58476D1CE4E5B9)
    x &= LOW
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    x &= LOW
    return x ^ (x >> U(32))


def _hash_piece(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of ``buf``."""
    arr = np.frombuffer(buf, np.uint8)
    edge = np.flatnonzero(np.diff(IS_WORD[arr].view(np.int8), prepend=0, append=0))
    if not len(edge):
        return np.empty(0, np.int64), np.empty(0, U)
    starts, n = edge[::2], edge[1::2] - edge[::2]
    lower = buf.lower()
    eight = np.ndarray(len(buf) + 1, "<u8", lower + bytes(8), strides=(1,))
    size = np.minimum(n, SHORT_WORD)
    h = _mix63(size.astype(U) << U(56) | eight[starts] & FIRST_BYTES[size]) << U(1)
    long = np.flatnonzero(n > SHORT_WORD)
    h[long] = np.fromiter(map(digests.__getitem__, [lower[a:b] for a, b in zip(starts[long].tolist(), (starts + n)[long].tolist(), strict=True)]), U, len(long))
    return starts, h


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > PIECE:
        cut = SPACE.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the n+1 offsets of each text's words."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    group: list[bytes] = []
    first = size = 0

    def flush() -> None:
        if group:
            starts, h = _hash_piece(b"\n".join(group))
            at = np.cumsum([0, *(len(t) + 1 for t in group)])
            counts[first : first + len(group)] = np.diff(np.searchsorted(starts, at))
            hashes.append(h)

    for i, text in enumerate(texts):
        if len(text) > PIECE or size + len(text) > PIECE:
            flush()
            group, first, size = [], i, 0
        if len(text) > PIECE:
            for piece in _pieces(text):
                h = _hash_piece(piece)[1]
                hashes.append(h)
                counts[i] += len(h)
            first = i + 1
            continue
        group.append(text)
        size += len(text) + 1
    flush()
    return np.concatenate(hashes or [np.empty(0, U)]), np.r_[0, np.cumsum(counts)]


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order."""
    if len(x) < 2:
        return x.copy()
    x = np.sort(x)
    keep = np.empty(len(x), bool)
    keep[0] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes; the result is shorter by n - 1.

    Two chains of other multipliers run side by side, and what comes out is made of both: a word that brings one of
    them back to where another run has it does not bring back the other.
    """
    if len(h) < n:
        return np.empty(0, U)
    out = np.empty(len(h) - n + 1, U)
    for a in range(0, len(out), PIECE):
        b = min(a + PIECE, len(out))
        one, two = h[a:b].copy(), ~h[a:b]
        for k in range(1, n):
            word = h[a + k : b + k]
            one ^= one >> U(29)
            one *= GRAM
            one += word
            two ^= two >> U(32)
            two *= OTHER_GRAM
            two ^= word
        out[a:b] = mix(mix(one ^ U(n)) + two)
    return out


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each text; a shorter text has its whole sequence as one."""
    h, at = word_hashes(texts)
    g = grams(h, n)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= n:
            out.append(distinct(g[a : b - n + 1]))
        else:
            out.append(grams(h[a:b], int(b - a)) if b > a else np.empty(0, U))
    return out


def blocks(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least."""
    a = size = 0
    for i, n in enumerate(lengths):
        if i > a and size + n > limit:
            yield a, i
            a, size = i, 0
        size += int(n)
    if len(lengths) > a:
        yield a, len(lengths)

"""Rabin-Karp hashing in numpy: words, fixed-length windows, and runs of windows that share a minimum.

Fingerprints are polynomials modulo the prime 2**61 - 1 at a base that was drawn at random: two different
strings of n symbols meet for at most n of all bases, however they are made. (Modulo 2**64 this doesn't
hold: there the Thue-Morse string of 1,024 symbols meets its complement at every odd base.) A polynomial
can be shifted by the base's inverse, so every window's fingerprint is two prefix sums and a product.
Fingerprints are mixed to 64 bits afterwards.

A window of L symbols is keyed by the least hash of the k-grams inside it. Equal windows have equal
keys wherever they stand, and neighbouring windows mostly share a key, so one row can speak for a
whole run of windows: two documents that repeat 50 words are found by comparing runs, and only runs
that differ somewhere are compared window by window.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
PRIME = (1 << 61) - 1
BASE = 0x1A7C90E4D3B5F62B
INVERSE = pow(BASE, -1, PRIME)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Windows one run holds at most; longer runs are split, counted from their own start.
RUN_MOST = 1 << 19
_P, _LOW, _MIDDLE = U(PRIME), U((1 << 31) - 1), U((1 << 30) - 1)
_PIECE = 1 << 14
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1, for any 64-bit x."""
    over = x >> U(61)
    over += x & _P
    np.subtract(over, _P, out=over, where=over >= _P)
    return over


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a1, a0, b1, b0 = a >> U(31), a & _LOW, b >> U(31), b & _LOW
    middle = a1 * b0
    b0 *= a0
    a0 *= b1
    middle += a0
    a1 *= b1
    a1 += a1
    a1 += b0
    a1 += middle >> U(30)
    middle &= _MIDDLE
    middle <<= U(31)
    a1 += middle
    return fold(a1)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, for factors below it: halves of 31 bits, as 2**61 is 1. Works in pieces
    that stay in the processor's cache."""
    if len(a) <= _PIECE:
        return _times(a, b)
    out = np.empty(len(a), U)
    for i in range(0, len(a), _PIECE):
        out[i : i + _PIECE] = _times(a[i : i + _PIECE], b[i : i + _PIECE])
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((BASE, INVERSE)):
            p = np.ones(1, U)
            while len(p) < size:
                p = np.concatenate([p, times(p, np.full(len(p), pow(base, len(p), PRIME), U))])
            _powers[k] = p[:size]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Sums:
    """Prefix sums of symbol * BASE**i modulo 2**61 - 1, from which any range's polynomial follows.
    Symbols are below 2**61; 0 isn't one, so that no string is another's with zeros added."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        shift = powers(n)[0]
        self.c = np.zeros(n + 1, U)
        for i in range(0, n, _PIECE):
            e = min(i + _PIECE, n)
            terms = _times(symbols[i:e], shift[i:e])
            high = np.cumsum(terms >> U(32))
            terms &= U(0xFFFFFFFF)
            low = np.cumsum(terms)
            low += high >> U(29)
            high &= U((1 << 29) - 1)
            high <<= U(32)
            low += high
            low += self.c[i]
            self.c[i + 1 : e + 1] = fold(low)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return times(fold(self.c[end] + (_P - self.c[start])), powers(len(self.c))[1][start])

    def grams(self, k: int) -> np.ndarray:
        """Mixed hashes of all k neighbours."""
        n = len(self.c) - k
        out = np.zeros(max(n, 0), U)
        shift = powers(len(self.c))[1]
        for i in range(0, n, _PIECE):
            e = min(i + _PIECE, n)
            out[i:e] = mix(_times(fold(self.c[i + k : e + k] + (_P - self.c[i:e])), shift[i:e]))
        return out


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words, and the first word's number of each document (one more than documents).
    UTF-8 never uses the six space bytes inside a character, so bytes are enough."""
    n = len(data)
    edge = np.empty(n + 1, bool)
    word = ~SPACE[data]
    edge[1:n] = word[1:] != word[: n - 1]
    edge[0] = n > 0 and word[0]
    edge[n] = n > 0 and word[n - 1]
    inner = offs[(offs > 0) & (offs < n)]
    both = inner[word[inner] & word[inner - 1]]  # a word ends and the next begins: an edge of each kind
    at = np.flatnonzero(edge)
    if len(both):
        at = np.sort(np.concatenate([at, np.repeat(np.unique(both), 2)]), kind="stable")
    starts, ends = at[0::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offs, "left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A symbol for each word, below 2**61 and not 0."""
    if not len(starts):
        return np.zeros(0, U)
    return np.maximum(mix(Sums(data.astype(U) + U(1)).ranges(starts, ends)) >> U(3), U(1))


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minima of all w neighbours, by doubling."""
    span = 1
    while span * 2 <= w:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[: len(a) - (w - span)], a[w - span :]) if span < w else a


def starts_of_windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol numbers at which a window of ``size`` fits into its document, and each one's document."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    total = int(counts.sum())
    doc = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.repeat(first[:-1] - before, counts) + np.arange(total), doc


def _several(grams: np.ndarray, every: np.ndarray, w: int, key: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a run's key stands at more than one place in the run; only then can it hold a window twice."""
    padded = np.zeros(len(every) + 2 * (w - 1), U)
    padded[w - 1 : w - 1 + len(every)] = every
    chosen = np.flatnonzero(~sliding_min(~padded, w) == grams)  # the least gram of some window
    lo, hi = np.searchsorted(chosen, start), np.searchsorted(chosen, start + n + w - 1)
    count = hi - lo
    entry = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    same = grams[chosen[entry]] == np.repeat(key, count)
    return np.bincount(np.repeat(np.arange(len(key)), count)[same], minlength=len(key)) > 1


def runs(symbols: np.ndarray, first: np.ndarray, size: int, gram: int, several: bool = False):
    """Runs of consecutive windows with the same least gram: key, hash of all the run covers, document,
    first symbol within the document, number of windows (and whether the key stands in it several times)."""
    at, doc = starts_of_windows(first, size)
    if not len(at):
        z = np.zeros(0, np.int64)
        return (z.astype(U), z.astype(U), z, z, z) + ((z.astype(bool),) if several else ())
    sums = Sums(symbols)
    grams = sums.grams(gram)
    every = sliding_min(grams, size - gram + 1)
    least = every[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(at)))
    if n.max(initial=0) > RUN_MOST:
        parts = -(-n // RUN_MOST)
        k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        head, left = np.repeat(head, parts) + k * RUN_MOST, np.repeat(n, parts) - k * RUN_MOST
        n = np.minimum(left, RUN_MOST)
    start = at[head]
    whole = mix(sums.ranges(start, start + n + size - 1))
    out = least[head], whole, doc[head], start - first[doc[head]], n
    return (*out, _several(grams, every, size - gram + 1, least[head], start, n)) if several else out


def window_hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    return Sums(symbols).grams(size)

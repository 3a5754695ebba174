"""How a quote differs from its source: longest common part and similarity, n log n in the length of long texts.

The longest common part is found by a binary search on its length. Substrings of one length are compared by polynomial hashes
of all positions at once; a table of bits leaves out most positions that have no partner before the others are sorted. What
is found is compared letter by letter. The hashes are taken modulo 2**64 at first; there are texts for which those lie, so
where the comparison fails the search is repeated modulo two primes, with another base each time. Short texts have sets of
their substrings in place of hashes.
"""

from __future__ import annotations

from itertools import count

import numpy as np

_PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
#: Bits of a hash that choose a place in the table, at most, and positions that are looked up before all are.
_TABLE, _FEW = 23, 256
#: Letters of two texts up to which sets of substrings are faster than the hashes.
_SHORT = 1500


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)


def _powers(base: int, n: int, prime: int | None) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    known = 1
    while known <= n:  # the powers known so far times the next one
        more, factor = min(known, n + 1 - known), int(out[known - 1]) * base
        out[known : known + more] = out[:more] * np.uint64(factor % (prime or 1 << 64))
        if prime:
            out[known : known + more] %= np.uint64(prime)
        known += more
    return out


class _Hashes:
    """Hashes of all substrings of two texts by prefix sums."""

    def __init__(self, texts: tuple[np.ndarray, np.ndarray], seed: int):
        rng = np.random.default_rng(seed)
        self.n, self.parts = max(map(len, texts)), []
        for prime in _PRIMES if seed > 1 else (None,):
            powers = _powers(int(rng.integers(1 << 21, _PRIMES[1])) | 1, self.n, prime)
            terms = [t * powers[: len(t)] % np.uint64(prime) if prime else t * powers[: len(t)] for t in texts]
            self.parts.append((prime, powers, [np.concatenate((np.zeros(1, np.uint64), np.cumsum(t, dtype=np.uint64))) for t in terms]))

    def of(self, text: int, length: int) -> np.ndarray:
        """A number for each substring of `length`."""
        out = 0
        for prime, powers, sums in self.parts:
            s = sums[text]
            own, factor = s[length:] - s[: len(s) - length], powers[self.n - (len(s) - length) + 1 : self.n + 1][::-1]
            out = (out << np.uint64(31) | own % np.uint64(prime) * factor % np.uint64(prime)) if prime else own * factor
        return out if self.parts[0][0] is None else out * np.uint64(0x9E3779B97F4A7C15)


def _partners(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of x that may have an equal in y, and what of y may have one in x."""
    bits = min(_TABLE, max(len(x), len(y)).bit_length() + 4)  # a table of the texts' size
    at = np.uint64(64 - bits)
    table = np.zeros(1 << bits, bool)
    table[y >> at] = True
    left = np.flatnonzero(table[x >> at])
    table[:] = False
    table[x[left] >> at] = True
    return left, y[table[y >> at]]


def _first_common(x: np.ndarray, y: np.ndarray, first: bool) -> int:
    """A position of x whose number is in y (the first one, if asked for), -1 if none is."""
    left, y = _partners(x, y)
    if not first and np.isin(y, x[left[:_FEW]]).any():
        return int(left[0])
    left = left[np.isin(x[left], y)] if len(left) else left
    return int(left[0]) if len(left) else -1


def _longest_of_short(a: str, b: str) -> tuple[int, int, int]:
    """The same by sets of the substrings of one length."""
    low, high, at = 0, min(len(a), len(b)) + 1, 0  # common at low, not at high
    while high - low > 1:
        n = (low + high) // 2
        known = {b[j : j + n] for j in range(len(b) - n + 1)}
        found = next((i for i in range(len(a) - n + 1) if a[i : i + n] in known), -1)
        low, high, at = (n, high, found) if found >= 0 else (low, n, at)
    return (at, b.find(a[at : at + low]), low) if low else (0, 0, 0)


def longest_common(a: str, b: str) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common part: the first in a of that length, and its first place in b."""
    if not a or not b:
        return 0, 0, 0
    if (at := b.find(a)) >= 0:
        return 0, at, len(a)
    if len(a) + len(b) <= _SHORT:
        return _longest_of_short(a, b)
    codes = (_codes(a), _codes(b))
    for seed in count(1):
        hashes = _Hashes(codes, seed)
        low, high = 0, min(map(len, codes)) + 1  # common at low, not at high
        while high - low > 1:
            length = (low + high) // 2
            found = _first_common(hashes.of(0, length), hashes.of(1, length), False)
            low, high = (length, high) if found >= 0 else (low, length)
        if not low:
            return 0, 0, 0
        i = _first_common(hashes.of(0, low), hashes.of(1, low), True)
        j = b.find(a[i : i + low])
        if j >= 0:
            return i, j, low


def _longest_within(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The same for short texts: lengths of common parts that end at each place of b, letter by letter of a."""
    best = (0, 0, 0)
    before = np.zeros(len(b) + 1, np.int32)
    for i, letter in enumerate(a):
        now = np.zeros(len(b) + 1, np.int32)
        np.multiply(before[:-1] + 1, b == letter, out=now[1:])
        if (n := int(now.max())) > best[2]:
            best = (i - n + 1, int(now.argmax()) - n, n)
        before = now
    return best


def similarity(a: str, b: str) -> float:
    """Twice the letters in common parts over all letters: the longest common part, and so on left and right of it."""
    if not a and not b:
        return 1.0
    x, y = _codes(a), _codes(b)
    total, rest = 0, [(0, len(x), 0, len(y))]
    while rest:
        alo, ahi, blo, bhi = rest.pop()
        if alo < ahi and blo < bhi:
            short = ahi - alo + bhi - blo <= _SHORT
            i, j, n = _longest_of_short(a[alo:ahi], b[blo:bhi]) if short else _longest_within(x[alo:ahi], y[blo:bhi])
            if n:
                total += n
                rest += [(alo, alo + i, blo, blo + j), (alo + i + n, ahi, blo + j + n, bhi)]
    return 2 * total / (len(a) + len(b))

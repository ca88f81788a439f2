"""Minwise hashes of character shingles, in bands, computed over Arrow batches with NumPy."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S = [np.uint64(x) for x in (30, 27, 31, 32)]
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _S[0])) * _M1
        x = (x ^ (x >> _S[1])) * _M2
        return x ^ (x >> _S[2])


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the offsets of the texts in them."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate(([0], np.cumsum(sizes)))


def shingle_hashes(cp: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixed 64-bit hashes of all k-character shingles, and the offsets of the texts in them.

    A text of less than k characters, also the empty one, has one shingle, the text itself.
    """
    n, sizes = len(cp), np.diff(offsets)
    wide = np.zeros(n + k, np.uint64)
    wide[:n] = cp.astype(np.uint64) + np.uint64(1)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h = np.zeros(n + 1, np.uint64)
        for j in range(k):
            h = h * base + wide[j : j + n + 1]
    short = np.flatnonzero(sizes < k)
    for i in short:
        v = np.uint64(len(cp[offsets[i] : offsets[i + 1]]) + 1)
        with np.errstate(over="ignore"):
            for c in cp[offsets[i] : offsets[i + 1]]:
                v = v * base + np.uint64(c)
        h[offsets[i]] = v if sizes[i] else np.uint64(0)
    counts = np.maximum(sizes - k + 1, 1)
    starts = np.concatenate(([0], np.cumsum(counts)))
    at = np.repeat(offsets[:-1] - starts[:-1], counts) + np.arange(starts[-1])
    return mix(h[at]), starts


@dataclass(frozen=True)
class Bands:
    """Parameters of one family of band keys: shingles of k characters, ``bands`` keys of ``rows`` minima each."""

    k: int
    rows: int
    bands: int
    seed: int = 1

    def keys(self, texts: list[str]) -> np.ndarray:
        """int64 band keys, one row for each text."""
        out = np.zeros((len(texts), self.bands), np.int64)
        rng = np.random.default_rng(self.seed)
        m = self.rows * self.bands
        a = rng.integers(0, 2**32, m, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        b = rng.integers(0, 2**32, m, dtype=np.uint64).astype(np.uint32)
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (size < CHUNK or j == i):
                size += len(texts[j])
                j += 1
            cp, offsets = code_points(texts[i:j])
            h, starts = shingle_hashes(cp, offsets, self.k)
            x = (h >> _S[3]).astype(np.uint32)
            minima = np.empty((m, j - i), np.uint64)
            with np.errstate(over="ignore"):
                for f in range(m):
                    minima[f] = np.minimum.reduceat(x * a[f] + b[f], starts[:-1])
                for g in range(self.bands):
                    key = np.full(j - i, np.uint64(self.seed * 1_000_003 + self.k * 1009 + g), np.uint64)
                    for f in range(g * self.rows, (g + 1) * self.rows):
                        key = mix(key + minima[f])
                    out[i:j, g] = key.view(np.int64)
            i = j
        return out


def multiset_jaccard(a: str, b: str, k: int) -> float:
    """Exact Jaccard similarity of the k-character shingles, counted with repetition."""
    x, y = (Counter(s[i : i + k] for i in range(max(1, len(s) - k + 1))) for s in (a, b))
    return (x & y).total() / (x | y).total()


def _numbered(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The hashes of each text, those of the second, third, ... occurrence changed by that number."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((h, text))
    x, t = h[order], text[order]
    new = np.concatenate(([True], (x[1:] != x[:-1]) | (t[1:] != t[:-1])))
    first = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    out = np.empty_like(h)
    with np.errstate(over="ignore"):
        out[order] = mix(x + (np.arange(len(x)) - first).astype(np.uint64))
    return out


def bitmaps(texts: list[str], k: int, width: int, numbered: bool = False) -> np.ndarray:
    """For each text a row of width / 64 words: the bits set by its k-character shingles, if numbered also by repetitions."""
    out = np.zeros((len(texts), width // 64), np.uint64)
    step = max(1, (1 << 24) // width)
    for i in range(0, len(texts), step):
        part = texts[i : i + step]
        h, starts = shingle_hashes(*code_points(part), k)
        h = _numbered(h, starts) if numbered else h
        on = np.zeros((len(part), width), bool)
        on[np.repeat(np.arange(len(part)), np.diff(starts)), (h & np.uint64(width - 1)).astype(np.int64)] = True
        out[i : i + step] = np.packbits(on, axis=1).view(np.uint64)
    return out


def few_lost(a: np.ndarray, u: np.ndarray, b: np.ndarray, v: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether at most ``most`` bits of a[u] are missing in b[v], and the other way round.

    An edit takes away at most k shingles of a text, so texts with d edits between them stay within k * d.
    """
    common = np.zeros(len(u), np.int32)
    for w in range(a.shape[1]):
        common += np.bitwise_count(a[:, w][u] & b[:, w][v])
    return np.maximum(np.bitwise_count(a).sum(1, dtype=np.int32)[u], np.bitwise_count(b).sum(1, dtype=np.int32)[v]) - common <= most


def counts(texts: list[str], k: int, width: int) -> np.ndarray:
    """How many k-character shingles of each text have each hash below ``width``."""
    h, starts = shingle_hashes(*code_points(texts), k)
    at = np.repeat(np.arange(len(texts)) * width, np.diff(starts)) + (h & np.uint64(width - 1)).astype(np.int64)
    return np.bincount(at, minlength=len(texts) * width).reshape(-1, width).astype(np.int32)


#: Longest text that distances_at_least() takes, and the classes of characters it tells apart.
WORD, SYMBOLS = 64, 64


def symbols(texts: list[str]) -> np.ndarray:
    """Each text of at most WORD characters as a row of character classes below SYMBOLS."""
    out = np.zeros((len(texts), WORD), np.uint8)
    cp, offsets = code_points(texts)
    n = np.diff(offsets)
    with np.errstate(over="ignore"):
        kind = (cp * np.uint32(2654435761)) >> np.uint32(26)
    out[np.repeat(np.arange(len(texts)), n), np.arange(len(cp)) - np.repeat(offsets[:-1], n)] = kind
    return out


def distances_at_least(a: np.ndarray, la: np.ndarray, u: np.ndarray, b: np.ndarray, lb: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Edit distances of the pairs (a[u], b[v]) of symbols() with lengths la and lb, all from 1 to WORD.

    Bit-parallel dynamic programming, one machine word a pair and all pairs of a block at once.  Characters of one
    class count as equal, so that the true distance may be more, never less.
    """
    places = np.zeros((len(a), SYMBOLS), np.uint64)
    for i in range(int(la.max(initial=0))):
        at = np.flatnonzero(la > i)
        places[at, a[at, i]] |= np.uint64(1 << i)
    one, out = np.uint64(1), np.empty(len(u), np.int32)
    flat = places.reshape(-1)
    for k in range(0, len(u), 1 << 12):
        # blocks of neighbouring pairs stay in the cache; the longest texts of a block come first
        rows = k + np.argsort(-lb[v[k : k + (1 << 12)]], kind="stable")
        p, n = u[rows] * SYMBOLS, lb[v[rows]]
        text = np.ascontiguousarray(b[v[rows], : int(n.max(initial=0))].T).astype(np.intp)
        live = np.searchsorted(-n, -np.arange(int(n.max(initial=0))), "left")
        score, top = la[u[rows]].astype(np.int64), (la[u[rows]] - 1).astype(np.uint64)
        up, down = np.full(len(rows), np.uint64(2**64 - 1)), np.zeros(len(rows), np.uint64)
        with np.errstate(over="ignore"):
            for j, m in enumerate(live):
                same = flat[p[:m] + text[j, :m]]
                pv, mv, t = up[:m], down[:m], top[:m]
                d = same & pv
                d += pv
                d ^= pv
                d |= same
                mh = pv & d
                d |= pv
                np.invert(d, out=d)
                d |= mv  # the places where the row rises
                score[:m] += ((d >> t) & one).view(np.int64)
                score[:m] -= ((mh >> t) & one).view(np.int64)
                d <<= one
                d |= one
                mh <<= one
                same |= mv
                np.bitwise_and(d, same, out=mv)
                d |= same
                np.invert(d, out=d)
                np.bitwise_or(mh, d, out=pv)
        out[rows] = score
    return out


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance of two strings, or some number above ``most`` if it is more than that.

    Bit-parallel dynamic programming with one long integer for a column: a tenth of the time of the built-in function.
    """
    if len(a) > len(b):
        a, b = b, a
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : n - j], b[i : len(b) - j]
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    score, every = len(a), (1 << len(a)) - 1
    last, pv, mv, left = 1 << (len(a) - 1), every, 0, len(b)
    for c in b:
        same = places.get(c, 0)
        d = (((same & pv) + pv) ^ pv) | same
        ph, mh = mv | (every ^ (every & (d | pv))), pv & d
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        left -= 1
        if score - left > most:
            return most + 1
        ph = (ph << 1 | 1) & every
        pv, mv = ((mh << 1) | (every ^ (every & (same | mv | ph)))) & every, ph & (same | mv)
    return score

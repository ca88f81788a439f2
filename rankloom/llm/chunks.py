"""Splitting oversized docs at natural boundaries by content-defined chunking."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP, WINDOW = 1200, 120, 32

_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*|\n\s*|[  ]\s*")
_SENTENCE = re.compile(r"(?:[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？；｡]+[”’」』）]*)\s*")
_WORD = re.compile(r"\s+|[，、：,;]\s*")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _inverse() -> np.uint64:
    x = 1
    for _ in range(6):
        x = x * (2 - int(_BASE) * x) % 2**64
    return np.uint64(x)


_BACK = _inverse()


def rolling_hash(codes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """At p, the mixed hash of the ``window`` characters before position p; positions before ``window`` use what is there."""
    n = len(codes)
    with np.errstate(over="ignore"):
        down = np.cumprod(np.full(n + 1, _BACK, np.uint64)) * _BASE
        up = np.cumprod(np.full(n + 1, _BASE, np.uint64)) * _BACK
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(codes.astype(np.uint64) * down[:n] + down[:n], out=total[1:])
        first = np.maximum(np.arange(n + 1) - window, 0)
        h = (total - total[first]) * up
        h ^= h >> np.uint64(32)
        h *= _MIX
        return h ^ (h >> np.uint64(29))


def _ends(rx: re.Pattern, s: str) -> np.ndarray:
    return np.fromiter((m.end() for m in rx.finditer(s)), np.int64)


def _nearest(ends: np.ndarray, at: int, lo: int, hi: int) -> int | None:
    i, j = np.searchsorted(ends, [lo, hi + 1])
    if i == j:
        return None
    part = ends[i:j]
    return int(part[np.argmin(np.abs(part - at))])


def cut(s: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, overlap) of the pieces of s; a text within the limit is one piece, the empty text none.

    A piece never exceeds the limit.  In the admitted stretch, from a third of the limit after the last cut to the
    limit, the landmark is where the rolling hash of the text before it is smallest.  The cut snaps from it to the
    nearest end of a paragraph, else of a sentence, else of a word; failing all these in the stretch, to the last such
    end before it that leaves more than the overlap, and in a text without any it is the landmark itself.  A landmark depends on the text around it
    only, so an edit moves the cuts near it, and the later ones fall on the old landmarks again.  Each piece after the
    first begins ``overlap`` characters before its cut, or at the end of a word within a third of that distance.
    """
    n = len(s)
    if n <= limit:
        return [(0, n, 0)] if n else []
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = rolling_hash(codes)
    ends = [_ends(rx, s) for rx in (_PARAGRAPH, _SENTENCE, _WORD)]
    every = np.unique(np.concatenate(ends))
    pieces, begin, last = [], 0, 0
    while n - begin > limit:
        lo, hi = last + limit // 3, begin + limit
        mark = lo + int(np.argmin(h[lo : hi + 1]))
        at = next((x for e in ends if (x := _nearest(e, mark, lo, hi)) is not None), None)
        if at is None:
            at = _nearest(every, lo, last + overlap + 1, lo)
        if at is None:
            at = mark
        pieces.append((begin, at, last - begin))
        last, floor = at, begin
        slack = overlap // 3
        begin = _nearest(every, at - overlap, max(floor + 1, at - overlap - slack), at - overlap + slack)
        if begin is None:
            begin = max(floor + 1, at - overlap)
    pieces.append((begin, n, last - begin))
    return pieces


_SPANS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("start_pos", "end_pos", "overlap")]))


def _spans(limit: int, overlap: int):
    @F.pandas_udf(_SPANS)
    def spans(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else [dict(zip(("start_pos", "end_pos", "overlap"), p)) for p in cut(x, limit, overlap)])

    return spans


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece_no from 1, start_pos, end_pos, overlap, piece) for every text of more than ``limit`` characters.

    Texts within the limit, empty and null ones give no piece; ids may be null or repeated and then stand as they are.
    The filter runs before Python is called, and the pieces are cut out of the column in the JVM; there is no shuffle.
    """
    if not 0 <= overlap < limit // 3:
        raise ValueError("overlap must be under a third of the limit")
    big = df.where(F.length(text_col) > limit).select(F.col(id_col), F.col(text_col).alias("_text"))
    each = big.select("*", F.posexplode(_spans(limit, overlap)(F.col("_text"))).alias("_i", "_p"))
    return each.select(
        id_col,
        (F.col("_i") + 1).alias("piece_no"),
        "_p.start_pos",
        "_p.end_pos",
        "_p.overlap",
        F.substring("_text", F.col("_p.start_pos") + 1, F.col("_p.end_pos") - F.col("_p.start_pos")).alias("piece"),
    )

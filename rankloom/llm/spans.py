"""Long exact spans shared between records, and fuzzy passages: shared k-mer seeds, exact extension, chains of seeds."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..skew import key128
from ..storage import materialize, small_or_shuffled
from .minhash import CHUNK, code_points, edit_distance, mix
from .overlap import _whole_tiles as whole_tiles

LEAST, K = 100, 40
#: Distinct surroundings of one seed that are compared with each other; where there are more, their windows are hashed.
COMPARED = 48

_B = 0x9E3779B97F4A7C15
_B2 = 0xC2B2AE3D27D4EB4F


def _power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 2**64))


def _ladder(cp: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hashes of all stretches of n characters (at i that of cp[i:i+n]), by doubling."""
    with np.errstate(over="ignore"):
        step, size = cp.astype(np.uint64) + np.uint64(1), 1
        out, have = None, 0
        while True:
            if n & size:
                if out is None:
                    out, have = step, size
                else:  # stretch of ``size`` first, then the ``have`` characters behind it
                    m = len(cp) - size - have + 1
                    out, have = step[:m] * _power(base, have) + out[size : size + m], have + size
            if size * 2 > n:
                return out
            m = len(step) - size
            step, size = step[:m] * _power(base, size) + step[size : size + m], size * 2


def _sliding(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over x[i:i+w] for each i."""
    size = 1
    while size * 2 <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(n, CHUNK).bit_length()
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            up, down = (np.full(size + 1, b, np.uint64) for b in (_B, pow(_B, -1, 2**64)))
            up[0] = down[0] = 1
            up, down = np.cumprod(up), np.cumprod(down)
        _POWERS[size] = up, down
    return _POWERS[size]


def seeds_of(texts: list[str], k: int = K, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash, hash of the surroundings) of the selected k-mers of the texts.

    Of every window of ``least`` characters the k-mer with the smallest hash is selected, so two texts with the same
    window have selected the same k-mer at the same place of it.  The surroundings of a seed are all windows that hold
    it: from least - k characters before it to least characters after its start, as far as the text goes.
    """
    cp, offsets = code_points(texts)
    n, w = len(cp), least - k + 1
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none, none
    h = mix(_ladder(cp, k, _B)) | np.uint64(1)
    low = _sliding(h, w, np.minimum)
    starts = np.arange(len(low))
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    low[starts + least > offsets[1:][doc[: len(low)]]] = 0  # a window that leaves its text
    top = _sliding(np.concatenate((np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64))), w, np.maximum)
    at = np.flatnonzero(top[: len(h)] == h)
    d = doc[at]
    lo, hi = np.maximum(at - (least - k), offsets[:-1][d]), np.minimum(at + least, offsets[1:][d])
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        total = np.concatenate(([np.uint64(0)], np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * down[:n], dtype=np.uint64)))
        around = mix((total[hi] - total[lo]) * up[lo]) + np.uint64(1_000_003) * (at - lo).astype(np.uint64) + (hi - lo).astype(np.uint64)
    return d, at - offsets[:-1][d], h[at].view(np.int64), mix(around).view(np.int64)


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (size < CHUNK or j == i):
            size += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j


def _seed_batches(k: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts = b["doc_id"].to_numpy(), b["text"].tolist()
            for first, part in _chunks(texts):
                d, pos, h, around = seeds_of(part, k, least)
                yield pd.DataFrame({"h": h, "around": around, "doc_id": ids[first + d], "pos": pos.astype(np.int32)})

    return run


_SEED = "h long, around long, doc_id long, pos int"


def _common(a: str, b: str, most: int) -> int:
    """Length of the common beginning."""
    lo, hi = 0, min(len(a), len(b), most)
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        m = (lo + hi + 1) // 2
        if a[:m] == b[:m]:
            lo = m
        else:
            hi = m - 1
    return lo


def extend(group: list[tuple[int, str, int, bool]], k: int, least: int) -> list[tuple[int, int] | None]:
    """For each (doc, surroundings, place of the seed in it, shared) how far around the seed it is shared elsewhere.

    The answer, (characters before the seed, characters from its start), is the union of all exact matches of at least
    ``least`` characters with a surrounding of another doc; None if there is none.  ``shared`` surroundings stand in
    several docs; for them the answer isn't needed.
    """
    out: list[tuple[int, int] | None] = []
    parts = [(doc, s[:p][::-1], s[p + k :], shared) for doc, s, p, shared in group]
    for doc, left, right, shared in parts:
        best = None
        if not shared:
            for doc2, left2, right2, shared2 in parts:
                if doc2 == doc and not shared2:
                    continue
                a, b = _common(left, left2, len(left)), _common(right, right2, len(right))
                if a + k + b >= least:
                    best = (a, k + b) if best is None else (max(best[0], a), max(best[1], k + b))
        out.append(best)
    return out


def _extend_batches(k: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def answer(b: pd.DataFrame) -> pd.DataFrame:
            hs, rows = b["h"].to_numpy(), []
            cols = list(zip(b["rep_doc"], b["s"], b["p"], b["shared"]))
            arounds = b["around"].to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(hs[1:] != hs[:-1]) + 1, [len(hs)]))
            for i, j in zip(edges[:-1], edges[1:]):
                for x, got in zip(range(i, j), extend(cols[i:j], k, least)):
                    if got:
                        rows.append((hs[x], arounds[x], got[0], got[1]))
            return pd.DataFrame(rows, columns=["h", "around", "before", "after"])

        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            hs = b["h"].to_numpy()
            last = int(np.flatnonzero(hs == hs[-1])[0]) if len(hs) else 0
            held = b.iloc[last:]
            if last:
                yield answer(b.iloc[:last])
        if held is not None and len(held):
            yield answer(held)

    return run


def _window_batches(k: int, least: int):
    """Hashes (128 bits) of all windows in each surrounding, for seeds with many surroundings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, j in ((x, x + 2000) for x in range(0, len(b), 2000)):
                part = b.iloc[i:j]
                cp, offsets = code_points(part["s"].tolist())
                if len(cp) < least:
                    continue
                h1, h2 = mix(_ladder(cp, least, _B)), mix(_ladder(cp, least, _B2))
                n = np.maximum(np.diff(offsets) - least + 1, 0)
                which = np.repeat(np.arange(len(part)), n)
                first = np.concatenate(([0], np.cumsum(n)))
                start = np.arange(first[-1]) - first[which]
                at = offsets[which] + start
                p = part["p"].to_numpy()[which]
                yield pd.DataFrame(
                    {
                        "w1": h1[at].view(np.int64),
                        "w2": h2[at].view(np.int64),
                        "h": part["h"].to_numpy()[which],
                        "around": part["around"].to_numpy()[which],
                        "rep_doc": part["rep_doc"].to_numpy()[which],
                        "shared": part["shared"].to_numpy()[which],
                        "before": (p - start).astype(np.int32),
                        "after": (start + least - p).astype(np.int32),
                    }
                )

    return run


def text_classes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): (key, doc_id, n_chars) of every text, and (key, rep, several) of equal texts."""
    members = materialize(df.where(F.col("text").isNotNull()).select("doc_id", key128(F.col("text")).alias("key"), F.length("text").alias("len")), "texts")
    classes = members.groupBy("key").agg(
        F.min("doc_id").alias("rep"), (F.min("doc_id") != F.max("doc_id")).alias("several"), F.max("len").alias("len")
    )
    return members, classes


def seeds(df: DataFrame, classes: DataFrame, k: int = K, least: int = LEAST, around: bool = True) -> DataFrame:
    """Selected seeds (h, doc_id, pos, and around if wanted) of one document of each class of equal texts."""
    reps = classes.select(F.col("rep").alias("doc_id"))
    docs = df.where(F.length("text") >= least).select("doc_id", "text")
    docs = docs.join(small_or_shuffled(reps), "doc_id", "left_semi")
    found = docs.mapInPandas(_seed_batches(k, least), _SEED)
    return materialize(found if around else found.drop("around"), "seeds")


def shared_seeds(all_seeds: DataFrame) -> DataFrame:
    """Occurrences of the seeds that stand in more than one class of texts."""
    known = all_seeds.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h")
    known = materialize(known, "shared-seeds")
    return materialize(all_seeds.join(small_or_shuffled(known), "h", "left_semi"), "occurrences")


def class_spans(df: DataFrame, classes: DataFrame, k: int = K, least: int = LEAST) -> DataFrame:
    """(doc_id, start_pos, end_pos): stretches shared with another class, for one document of each class; not merged."""
    occ = shared_seeds(seeds(df, classes, k, least))
    about = occ.groupBy("h", "around").agg(
        F.min("doc_id").alias("rep_doc"), F.max("doc_id").alias("last_doc"), F.min(F.struct("doc_id", "pos")).alias("rep")
    )
    about = about.select("h", "around", (F.col("rep_doc") < F.col("last_doc")).alias("shared"), "rep_doc", F.col("rep.pos").alias("rep_pos"))
    about = materialize(about, "surroundings")
    groups = about.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("shared")).cast("int")).alias("single"))
    groups = materialize(groups.where((F.col("n") > 1) & (F.col("single") > 0)).select("h", "n"), "open-seeds")
    wanted = materialize(about.join(small_or_shuffled(groups), "h"), "wanted")
    docs = df.select(F.col("doc_id").alias("rep_doc"), "text").where(F.length("text") >= least)
    lo = F.greatest(F.col("rep_pos") - (least - k), F.lit(0))
    cut = docs.join(small_or_shuffled(wanted, 200_000), "rep_doc").select(
        "h",
        "around",
        "shared",
        "rep_doc",
        "n",
        F.substring("text", lo + 1, F.col("rep_pos") + least - lo).alias("s"),
        (F.col("rep_pos") - lo).alias("p"),
    )
    cut = materialize(cut, "cuttings")
    few = cut.where(F.col("n") <= COMPARED).repartition("h").sortWithinPartitions("h")
    reach = few.mapInPandas(_extend_batches(k, least), "h long, around long, before int, after int")
    windows = cut.where(F.col("n") > COMPARED).mapInPandas(
        _window_batches(k, least), "w1 long, w2 long, h long, around long, rep_doc long, shared boolean, before int, after int"
    )
    windows = materialize(windows, "windows")
    twice = windows.groupBy("w1", "w2").agg(F.min("rep_doc").alias("a"), F.max("rep_doc").alias("b"), F.max("shared").alias("s"))
    twice = twice.where("a < b or s").select("w1", "w2")
    many = windows.where(~F.col("shared")).join(twice, ["w1", "w2"], "left_semi").select("h", "around", "before", "after")
    reach = reach.unionByName(many).groupBy("h", "around").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    whole = occ.join(about.where("shared").select("h", "around"), ["h", "around"], "left_semi")
    whole = whole.select("doc_id", F.greatest(F.col("pos") - (least - k), F.lit(0)).alias("start_pos"), (F.col("pos") + least).alias("end_pos"))
    part = occ.join(reach, ["h", "around"]).select(
        "doc_id", (F.col("pos") - F.col("before")).alias("start_pos"), (F.col("pos") + F.col("after")).alias("end_pos")
    )
    return whole.unionByName(part)


def merged(spans: DataFrame) -> DataFrame:
    """Union of the stretches of each document: runs that touch or overlap become one."""
    by_start = Window.partitionBy("doc_id").orderBy("start_pos", "end_pos")
    reach = F.max("end_pos").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.coalesce((F.col("start_pos") > reach).cast("int"), F.lit(1)))
    new = new.withColumn("run", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return new.groupBy("doc_id", "run").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("run")


def shared_spans(df: DataFrame, k: int = K, least: int = LEAST) -> DataFrame:
    """(doc_id, start_pos, end_pos): maximal runs covered by stretches of ``least`` characters found in another doc_id.

    Texts under that length, empty and null ones share nothing.  Equal texts are handled as one: if they stand under
    several ids they are shared from end to end, and else they share what their representative shares.  A repeated
    doc_id with the same text counts as one record; extra columns are ignored.

    No pairs of documents are formed.  Seeds that occur in one class only are dropped by their counts; occurrences
    with equal surroundings are handled as one; of the others the surroundings are compared exactly, or, if a seed has
    more than COMPARED different ones, their windows are grouped by hash.
    """
    members, classes = text_classes(df)
    classes = materialize(classes, "text-classes")
    spans = materialize(class_spans(df, classes, k, least), "stretches")
    ends = members.join(classes.select("key", "rep", "several"), "key")
    spans = merged(spans.join(small_or_shuffled(classes.select(F.col("rep").alias("doc_id"), "len")), "doc_id").select(
        "doc_id", "start_pos", F.least("end_pos", "len").alias("end_pos")
    ))
    whole = ends.where(F.col("several") & (F.col("len") >= least)).select("doc_id", F.lit(0).alias("start_pos"), F.col("len").alias("end_pos")).distinct()
    once = classes.where(~F.col("several")).select(F.col("rep").alias("doc_id"))
    return whole.unionByName(spans.join(once, "doc_id", "left_semi"))


def shared_amount(df: DataFrame, k: int = K, least: int = LEAST) -> DataFrame:
    """(doc_id, n_chars, shared_chars, n_spans) of every document; null texts have 0 characters."""
    got = shared_spans(df, k, least).groupBy("doc_id").agg(
        F.sum(F.col("end_pos") - F.col("start_pos")).cast("long").alias("shared_chars"), F.count(F.lit(1)).alias("n_spans")
    )
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return df.select("doc_id", n.alias("n_chars")).join(got, "doc_id", "left").fillna(0, ["shared_chars", "n_spans"])


class Fenwick:
    """Prefix maxima with updates, in logarithmic time."""

    def __init__(self, n: int) -> None:
        self.best = [(float("-inf"), -1)] * (n + 1)

    def update(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def prefix(self, i: int) -> tuple[float, int]:
        """Largest value at places before i."""
        got = (float("-inf"), -1)
        while i > 0:
            if self.best[i] > got:
                got = self.best[i]
            i -= i & -i
        return got


def _overlapping(ends: list[tuple[int, int, int, int]], score: list[float], a: int, b: int, n: int, gap: float) -> tuple[float, int]:
    """Best (score, number) of a stretch (a, b, n) behind one of those that overlap it and begin before it on both sides."""
    best = (float("-inf"), -1)
    if len(ends) > 64:  # many repetitions in both texts
        x = np.array(ends, dtype=np.int64)
        cut = np.maximum(x[:, 2] - a, x[:, 3] - b)
        at = np.flatnonzero((x[:, 0] < a) & (x[:, 1] < b) & (cut > 0) & (cut < n))
        if len(at):
            x, cut = x[at], cut[at]
            got = np.array([score[j] for j in at]) + n - cut - gap * (a + b + 2 * cut - x[:, 2] - x[:, 3])
            best = (float(got.max()), int(at[got.argmax()]))
        return best
    for j, (a0, b0, a1, b1) in enumerate(ends):
        cut = max(a1 - a, b1 - b)
        if a0 < a and b0 < b and 0 < cut < n:
            best = max(best, (score[j] + n - cut - gap * (a + b + 2 * cut - a1 - b1), j))
    return best


def chain(matches: list[tuple[int, ...]], k: int = K, gap: float = 0.1, least: float = LEAST) -> list[tuple[int, int, int, int, float]]:
    """Collinear chains (start_a, end_a, start_b, end_b, score) of matches (position in a, position in b, length or else k).

    A chain's score is the characters its matches cover in a, less ``gap`` for each character of a and b between them.
    Matches are taken by their place in a; the best predecessor is the prefix maximum, over the ends in b, of score
    plus gap times (end in a + end in b).  An overlapping predecessor of a match of k characters counts its new
    characters only where both sides advance alike; matches with a length are cut to what lies behind it on both sides.
    Chains are taken by score, each match in one chain at most, those under ``least`` left out.
    """
    matches = sorted({(*m, k)[:3] if len(m) == 2 else m for m in matches})
    fixed = all(n == k for _, _, n in matches)
    places = sorted({b + n for _, b, n in matches})
    tree, score, before = Fenwick(len(places)), [], []
    last_on: dict[int, int] = {}
    ends: list[tuple[int, int, int, int]] = []
    waiting: list[tuple[int, int]] = []  # (end in a, match) that can't be a predecessor yet
    for i, (a, b, n) in enumerate(matches):
        while waiting and waiting[0][0] <= a:
            j = heappop(waiting)[1]
            end_b = matches[j][1] + matches[j][2]
            tree.update(bisect_left(places, end_b), (score[j] + gap * (ends[j][2] + end_b), j))
        s, p = float(n), -1
        got, j = tree.prefix(bisect_right(places, b))
        if j >= 0 and got - gap * (a + b) + n > s:
            s, p = got - gap * (a + b) + n, j
        j = last_on.get(a - b, -1)
        if j >= 0 and a < ends[j][2] < a + n and score[j] + (a + n - ends[j][2]) > s:
            s, p = score[j] + (a + n - ends[j][2]), j
        last_on[a - b] = i
        if not fixed:
            got, j = _overlapping(ends, score, a, b, n, gap)
            if got > s:
                s, p = got, j
        score.append(s)
        before.append(p)
        ends.append((a, b, a + n, b + n))
        heappush(waiting, (a + n, i))
    out, used = [], [False] * len(matches)
    for i in sorted(range(len(matches)), key=lambda x: (-score[x], x)):
        if used[i] or score[i] < least:
            continue
        j, path = i, []
        while j >= 0 and not used[j]:
            path.append(j)
            j = before[j]
        # without what another chain has taken, the best beginning may be a later one; what is before it stays free
        path.reverse()
        first, got = 0, float(matches[path[0]][2])
        for q in range(1, len(path)):
            got += score[path[q]] - score[path[q - 1]]
            if matches[path[q]][2] > got:
                first, got = q, float(matches[path[q]][2])
        for j in path[first:]:
            used[j] = True
        if got >= least:
            j = path[first]
            out.append((matches[j][0], ends[i][2], matches[j][1], ends[i][3], round(got, 3)))
    return out


PASSAGE_K, PASSAGE_WINDOW = 24, 48
#: Documents of one side of a tile, characters that are compared at once, and matches.  How, changes no result.
DOCS_OF_TILE, _CHARS, _MATCHES = 1_500, 1 << 22, 1 << 20


class _Texts:
    """Texts as code points, with what their pairs have in common."""

    def __init__(self, texts: list[str], k: int, window: int) -> None:
        self.texts, self.k, self.most = texts, k, window - k
        self.cp, self.offsets = code_points(texts)
        parts = [(first + d, pos, h) for first, part in _chunks(texts) for d, pos, h, _ in [seeds_of(part, k, window)]]
        self.row, self.pos, self.h = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))

    def same(self, at: np.ndarray, u: np.ndarray, v: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of the rows ``at`` have one character at place x of text u and at place y of text v."""
        u, v, x, y = u[at], v[at], x[at], y[at]
        x, y = x + self.offsets[u], y + self.offsets[v]
        inside = (x >= self.offsets[u]) & (y >= self.offsets[v]) & (x < self.offsets[u + 1]) & (y < self.offsets[v + 1])
        at, x, y = at[inside], x[inside], y[inside]
        return at[self.cp[x] == self.cp[y]]

    def stretches(self, u: np.ndarray, v: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """(u, v, start in u, start in v, length) of the maximal equal stretches around the matches (x of u, y of v).

        A stretch of a window or more holds matches that begin at most window - k + 1 apart, the first and last of them as
        near to its ends, so that so many characters are looked at on each side.
        """
        order = np.lexsort((x, x - y, v, u))
        u, v, x, y = u[order], v[order], x[order], y[order]
        n = np.full(len(u), self.k, np.int64)
        for widen in (False, True):
            if widen:
                at, ends = np.arange(len(u)), (x + n, y + n)
                for t in range(self.most + 1):
                    at = self.same(at, u, v, ends[0] + t, ends[1] + t)
                    n[at] += 1
                at = np.arange(len(u))
                x, y = x.copy(), y.copy()
                for _ in range(self.most + 1):
                    at = self.same(at, u, v, x - 1, y - 1)
                    x[at], y[at], n[at] = x[at] - 1, y[at] - 1, n[at] + 1
            # what touches or overlaps on one diagonal is one stretch
            line = np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (x[1:] - y[1:] != x[:-1] - y[:-1])))[: len(u)]
            number = np.cumsum(line)
            wide = int((x + n).max(initial=0)) + 1
            reach = np.maximum.accumulate(x + n + number * wide) - number * wide
            new = line.copy()
            new[1:] |= x[1:] > reach[:-1]
            at = np.flatnonzero(new)
            if len(at):
                n = np.append(reach[at[1:] - 1], reach[-1]) - x[at]
                u, v, x, y = u[at], v[at], x[at], y[at]
        return u, v, x, y, n

    def chains(self, u: np.ndarray, v: np.ndarray, x: np.ndarray, y: np.ndarray, gap: float, least: int) -> list[tuple]:
        """(u, v, start_a, end_a, start_b, end_b, score, identity) of the chains of the matches (x of u, y of v)."""
        u, v, x, y, n = self.stretches(u, v, x, y)
        out: list[tuple] = []
        edges = np.concatenate(([0], np.flatnonzero((u[1:] != u[:-1]) | (v[1:] != v[:-1])) + 1, [len(u)])) if len(u) else np.zeros(1, np.int64)
        first, many = edges[:-1], np.diff(edges)
        total = np.add.reduceat(n, first) if len(first) else first
        one = first[(many == 1) & (total >= least)]
        out += zip(u[one], v[one], x[one], x[one] + n[one], y[one], y[one] + n[one], n[one].astype(float), np.ones(len(one)))
        several = np.flatnonzero((many > 1) & (total >= least))
        for i, j in zip(first[several], edges[1:][several]):
            a, b = self.texts[u[i]], self.texts[v[i]]
            for c in chain(list(zip(x[i:j].tolist(), y[i:j].tolist(), n[i:j].tolist())), self.k, gap, least):
                s, t = a[c[0] : c[1]], b[c[2] : c[3]]
                longer = max(len(s), len(t))
                out.append((u[i], v[i], *c, round(1 - edit_distance(s, t, longer) / longer, 4)))
        return out


_CHAIN = "start_a int, end_a int, start_b int, end_b int, score double, identity double"


def _table(rows: list[tuple], ids: np.ndarray) -> pd.DataFrame:
    b = pd.DataFrame(rows, columns=["doc_a", "doc_b", "start_a", "end_a", "start_b", "end_b", "score", "identity"])
    return b.assign(doc_a=ids[b["doc_a"].to_numpy(np.int64)], doc_b=ids[b["doc_b"].to_numpy(np.int64)])


def _tile_batches(k: int, window: int, gap: float, least: int):
    """Chains of the pairs of documents of each tile that don't meet in a tile of a smaller number."""

    def some(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        b = b.sort_values(["tile", "doc_id"], kind="stable").drop_duplicates(["tile", "doc_id"])
        ids, own, chunk = b["doc_id"].to_numpy(), b["first"].to_numpy(), b["chunk"].to_numpy()
        _, tile = np.unique(b["tile"].to_numpy(), return_inverse=True)
        texts = _Texts(b["text"].tolist(), k, window)
        # all tiles of each document, as sorted numbers row * n + place of the tile among all
        lists = b["firsts"].tolist()
        place, many = np.unique(np.concatenate([*lists, own]), return_inverse=True)[1], np.fromiter(map(len, lists), np.int64, len(b))
        own_place, place = place[len(place) - len(b) :], place[: len(place) - len(b)]
        begins, wide = np.concatenate(([0], np.cumsum(many))), len(place) + len(b) + 1
        held = np.sort(np.repeat(np.arange(len(b)), many) * wide + place)
        order = np.lexsort((texts.pos, texts.row, texts.h, tile[texts.row]))
        row, pos, h = texts.row[order], texts.pos[order], texts.h[order]
        if not len(row):
            return
        key = np.concatenate(([True], (h[1:] != h[:-1]) | (tile[row[1:]] != tile[row[:-1]])))
        doc = key | np.concatenate(([True], row[1:] != row[:-1]))
        ends = [np.append(np.flatnonzero(z)[1:], len(row))[np.cumsum(z) - 1] for z in (doc, key)]
        # a seed meets those of the documents behind its own
        n = ends[1] - ends[0]
        by_row = np.argsort(row, kind="stable")
        by_row = by_row[n[by_row] > 0]
        upto = np.concatenate(([0], np.cumsum(n[by_row])))
        last = np.append(np.flatnonzero(row[by_row][1:] != row[by_row][:-1]) + 1, len(by_row))
        i = 0
        while i < len(by_row):
            j = max(int(last[np.searchsorted(last, i, "right")]), int(last[max(0, np.searchsorted(upto[last], upto[i] + _MATCHES, "right") - 1)]))
            at = by_row[i:j]
            m = n[at]
            left = np.repeat(at, m)
            right = np.repeat(ends[0][at], m) + np.arange(upto[j] - upto[i]) - np.repeat(upto[i:j] - upto[i], m)
            i = j
            pair, which = np.unique(row[left] * np.int64(len(b)) + row[right], return_inverse=True)
            u, v = pair // len(b), pair % len(b)
            good = (chunk[u] < 0) | (chunk[u] != chunk[v])
            other = np.repeat(np.arange(len(pair)), many[u])
            there = place[np.repeat(begins[u], many[u]) + np.arange(len(other)) - np.repeat(np.cumsum(many[u]) - many[u], many[u])]
            smaller = there < own_place[u[other]]
            other, there = other[smaller], there[smaller]
            wanted = v[other] * wide + there
            found = held[np.minimum(np.searchsorted(held, wanted), len(held) - 1)] == wanted
            good[other[found]] = False
            good = good[which]
            left, right = left[good], right[good]
            yield _table(texts.chains(row[left], row[right], pos[left], pos[right], gap, least), ids)

    def answer(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        tiles, upto = b["tile"].to_numpy(), np.cumsum(b["text"].str.len().to_numpy())
        edges = np.append(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1, len(b))
        i = 0
        for e, after in zip(edges, np.append(edges[1:], 0)):
            if not after or upto[after - 1] - (upto[i - 1] if i else 0) > _CHARS:
                yield from some(b.iloc[i:e])
                i = e

    return whole_tiles(answer)


def _own_batches(k: int, window: int, gap: float, least: int):
    """Chains of texts with themselves, for texts that stand under several ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["doc_id"].to_numpy()
            for r, text in enumerate(b["text"]):
                texts = _Texts([text], k, window)
                order = np.argsort(texts.h, kind="stable")
                h, pos = texts.h[order], texts.pos[order]
                low, high = (np.searchsorted(h, h, side) for side in ("left", "right"))
                m = high - low
                right = np.repeat(low, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                zero = np.zeros(len(right), np.int64)
                yield _table(texts.chains(zero, zero, np.repeat(pos, m), pos[right], gap, least), ids[r : r + 1])

    return run


def _covers(most: int, k: int, least: int):
    """For the pairs of documents of each tile what stretches around their shared seeds can hold at most.

    A match lies in an equal stretch that goes on for ``most`` characters on each side up to the next match, if there is
    one.  Gives (first, a, null, least) for each document of a pair that can reach ``least``, (first, a, b, cover) of the other pairs.
    """

    def answer(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        b = b.sort_values(["tile", "h", "doc_id", "pos"], kind="stable").drop_duplicates(["tile", "h", "doc_id", "pos"])
        first, chunk, doc, pos = (b[c].to_numpy() for c in ("first", "chunk", "doc_id", "pos"))
        tile, h = b["tile"].to_numpy(), b["h"].to_numpy()
        key = np.concatenate(([True], (h[1:] != h[:-1]) | (tile[1:] != tile[:-1])))
        run = np.flatnonzero(key | np.concatenate(([True], doc[1:] != doc[:-1])))
        # each occurrence meets, once, the documents of its seed behind its own
        number = np.searchsorted(run, np.arange(len(b)), "right")
        n = np.searchsorted(run, np.append(np.flatnonzero(key)[1:], len(b))[np.cumsum(key) - 1], "left") - number
        _, names = np.unique(tile, return_inverse=True)
        docs, numbers = np.unique(doc, return_inverse=True)
        order = np.lexsort((pos, numbers, names))
        order = order[n[order] > 0]
        row = names[order] * np.int64(len(docs)) + numbers[order]
        upto = np.concatenate(([0], np.cumsum(n[order])))
        last = np.append(np.flatnonzero(row[1:] != row[:-1]) + 1, len(order))
        i = 0
        while i < len(order):
            j = max(int(last[np.searchsorted(last, i, "right")]), int(last[max(0, np.searchsorted(upto[last], upto[i] + _MATCHES, "right") - 1)]))
            at = order[i:j]
            m = n[at]
            left = np.repeat(at, m)
            right = run[np.repeat(number[at], m) + np.arange(upto[j] - upto[i]) - np.repeat(upto[i:j] - upto[i], m)]
            i = j
            good = (chunk[left] < 0) | (chunk[left] != chunk[right])
            left, right = left[good], right[good]
            if not len(left):
                continue
            # rows of one document of one tile come in order of place, so a stable sort by pair keeps that order
            pair = (names[left] - names[left].min()) * np.int64(len(docs)) ** 2 + numbers[left] * np.int64(len(docs)) + numbers[right]
            by_pair = np.argsort(pair, kind="stable")
            left, right, pair = left[by_pair], right[by_pair], pair[by_pair]
            new = np.concatenate(([True], pair[1:] != pair[:-1]))
            step = np.append(pos[left][1:] - pos[left][:-1], 0).astype(np.int64)
            step = np.where(np.append(new[1:], True), k + 2 * most, np.minimum(step, k + 2 * most))
            start = np.flatnonzero(new)
            cover = np.add.reduceat(step, start)
            u, v = left[start], right[start]
            sure = cover >= least
            sides = np.concatenate((u[sure], v[sure]))
            marks = pd.DataFrame({"first": first[sides], "a": doc[sides]}).drop_duplicates().assign(b=None, cover=least)
            yield marks
            yield pd.DataFrame({"first": first[u], "a": doc[u], "b": doc[v], "cover": cover})[~sure]

    return whole_tiles(answer)


def _in_tiles(rows: DataFrame) -> DataFrame:
    """The rows (first, doc_id, ...) of documents in tiles named first, with columns tile and chunk.

    A tile of more than DOCS_OF_TILE documents is cut into chunks, of which each meets each; chunk is -1 where all pairs count.
    """
    cuts = rows.groupBy("first").agg(F.ceil(F.approx_count_distinct("doc_id") / F.lit(DOCS_OF_TILE)).cast("int").alias("cuts"))
    cuts = materialize(cuts.where("cuts > 1"), "cut-tiles")
    at = rows.join(small_or_shuffled(cuts), "first", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    at = at.withColumn("i", F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.col("cuts")).cast("int"))
    at = at.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    tile = F.xxhash64("first", F.least("i", "j"), F.greatest("i", "j"))
    chunk = F.when(F.col("i") == F.col("j"), F.lit(-1)).otherwise(F.col("i"))
    return at.withColumn("tile", tile).withColumn("chunk", chunk).drop("cuts", "i", "j")


def tiles_of(occ: DataFrame, k: int, window: int, least: int) -> DataFrame:
    """(doc_id, firsts, places): the tiles (tile, first, chunk) where the texts meet whose shared seeds may make ``least`` characters.

    A seed's documents meet in the tile of the first of them, by hash; so the seeds of one passage make one tile or few.
    Documents come without their texts at first, and pairs whose seeds can't cover ``least`` characters are left out.
    """
    first = materialize(occ.groupBy("h").agg(F.min(F.xxhash64(F.lit(5), "doc_id")).alias("first")), "first-documents")
    at = materialize(occ.select("h", "doc_id", "pos").join(first, "h"), "seeds-of-tiles")
    at = _in_tiles(at).repartition("tile").sortWithinPartitions("tile")
    covers = at.mapInPandas(_covers(window - k, k, least), "first long, a long, b long, cover long")
    covers = materialize(covers, "covers")
    # pairs that have seeds in several tiles
    more = covers.where(F.col("b").isNotNull()).groupBy("a", "b").agg(F.sum("cover").alias("cover"), F.min("first").alias("first"))
    more = more.where(F.col("cover") >= least).select("first", F.explode(F.array("a", "b")).alias("doc_id"))
    docs = covers.where(F.col("b").isNull()).select("first", F.col("a").alias("doc_id")).unionByName(more).distinct()
    docs = _in_tiles(materialize(docs, "documents-of-tiles"))
    docs = docs.select("doc_id", F.struct("tile", "first", "chunk").alias("place"))
    docs = docs.groupBy("doc_id").agg(F.collect_list("place").alias("places"), F.sort_array(F.collect_set("place.first")).alias("firsts"))
    return materialize(docs, "tiles-of-documents")


def passages(df: DataFrame, k: int = PASSAGE_K, window: int = PASSAGE_WINDOW, gap: float = 0.1, least: int = LEAST) -> DataFrame:
    """(doc_a, doc_b, start_a, end_a, start_b, end_b, score, identity): fuzzy passages of doc_b that stand in doc_a too.

    All pairs of documents, doc_a < doc_b, those of equal texts included; equal texts are compared once and their chains
    given to all their ids.  Documents that share a seed meet in a tile with their texts.  The shared seeds of two are
    extended to the maximal equal stretches, so that every stretch of ``window`` characters counts in full; these are
    chained in order of place with gap costs, and each chain is aligned: identity is 1 - edit distance / length of the
    longer passage.
    """
    members, classes = text_classes(df)
    classes = materialize(classes, "text-classes")
    occ = shared_seeds(seeds(df, classes, k, window, False))
    texts = df.select("doc_id", "text").where(F.length("text") >= least)
    rows = texts.join(small_or_shuffled(tiles_of(occ, k, window, least), 200_000), "doc_id")
    rows = rows.withColumn("place", F.explode("places")).select("place.tile", "doc_id", "text", "place.first", "place.chunk", "firsts")
    rows = rows.repartition("tile").sortWithinPartitions("tile")
    chains = rows.mapInPandas(_tile_batches(k, window, gap, least), f"doc_a long, doc_b long, {_CHAIN}")
    several = materialize(classes.where(F.col("several") & (F.col("len") >= least)).select(F.col("rep").alias("doc_id")), "several")
    own = texts.join(small_or_shuffled(several), "doc_id").dropDuplicates(["doc_id"])
    own = own.mapInPandas(_own_batches(k, window, gap, least), f"doc_a long, doc_b long, {_CHAIN}")
    chains = materialize(chains.unionByName(own), "chains")
    # the ids of equal texts; a class of one id has its own
    ids = members.select("key", "doc_id").distinct().join(classes.where("several").select("key", "rep"), "key").select("rep", "doc_id")
    ids = materialize(ids, "ids-of-texts")
    for side in "ab":
        other = ids.select(F.col("rep").alias(f"doc_{side}"), F.col("doc_id").alias(f"id_{side}"))
        chains = chains.join(small_or_shuffled(other), f"doc_{side}", "left").withColumn(f"id_{side}", F.coalesce(f"id_{side}", f"doc_{side}"))
    chains = chains.where((F.col("doc_a") != F.col("doc_b")) | (F.col("id_a") < F.col("id_b")))
    turned = F.col("id_a") > F.col("id_b")
    a, b = ([F.col(f"{c}_{x}") for c in ("id", "start", "end")] for x in "ab")
    swapped = [F.when(turned, y).otherwise(x).alias(f"{n}_{s}") for s, p, q in (("a", a, b), ("b", b, a)) for n, x, y in zip(("doc", "start", "end"), p, q)]
    return chains.select(*swapped, "score", "identity").select("doc_a", "doc_b", "start_a", "end_a", "start_b", "end_b", "score", "identity")

"""Filling fixed-capacity containers: exact complements of lengths first, best fit for what is left.

Containers are planned for lengths, not for items: a histogram of lengths has no more entries than the capacity, so
the plan is made on the driver in a size that doesn't depend on the data, and every item finds its container from its
length and its number among the items of that length.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..skew import with_offsets
from ..storage import materialize
from .tokens import VOCABULARY, with_tokens

CAPACITY = 2048


def exact_patterns(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, containers) whose lengths sum to the capacity: singles, pairs, then triples; counts is reduced."""
    found: list[tuple[tuple[int, ...], int]] = []
    if counts[capacity]:
        found.append(((capacity,), int(counts[capacity])))
        counts[capacity] = 0
    for a in range(capacity - 1, (capacity + 1) // 2 - 1, -1):
        b = capacity - a
        n = int(min(counts[a], counts[b])) if a != b else int(counts[a]) // 2
        if n:
            found.append(((a, b), n))
            counts[a] -= n
            counts[b] -= n
    for a in range(capacity - 2, (capacity + 2) // 3 - 1, -1):
        while counts[a]:
            gap = capacity - a
            b = np.arange(min(a, gap - 1), (gap + 1) // 2 - 1, -1)
            c = gap - b
            # availability of each pair behind a, where lengths may be the same
            n = np.minimum(np.where(b == a, counts[b] // 2, np.minimum(counts[a], counts[b])), counts[c])
            n = np.where(b == c, np.minimum(counts[b] // (3 if gap == 2 * a else 2), counts[a]), n)
            hit = np.flatnonzero(n > 0)
            if not len(hit):
                break
            i = int(hit[0])
            m = int(n[i])
            if b[i] == a and c[i] == a:
                m = int(counts[a]) // 3
                if not m:
                    break
            found.append(((a, int(b[i]), int(c[i])), m))
            for x in (a, int(b[i]), int(c[i])):
                counts[x] -= m
    return found


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, containers) for all lengths left, longest first, each into the fullest containers that have room."""
    gaps: list[int] = []
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(gap: int, pattern: tuple[int, ...], n: int) -> None:
        if gap not in groups:
            groups[gap] = []
            insort(gaps, gap)
        groups[gap].append((pattern, n))

    for length in range(capacity, 0, -1):
        n = int(counts[length])
        while n:
            i = bisect_left(gaps, length)
            if i == len(gaps):
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    put(capacity - each * length, (length,) * each, full)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            gap = gaps[i]
            pattern, m = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                gaps.pop(i)
            fit = min(gap // length, n)
            take = min(m, n // fit)
            put(gap - fit * length, pattern + (length,) * fit, take)
            if take < m:
                put(gap, pattern, m - take)
            n -= take * fit
        counts[length] = 0
    return [g for group in groups.values() for g in group]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[pd.DataFrame, int]:
    """Runs of items (length, first, last, container, each) and the number of containers.

    The items of a length numbered first up to last (exclusive) go, ``each`` at a time, into the containers from
    ``container`` on.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    used = np.zeros(capacity + 1, np.int64)
    runs, container = [], 0
    for pattern, n in exact_patterns(counts, capacity) + best_fit(counts, capacity):
        for length in dict.fromkeys(pattern):
            each = pattern.count(length)
            runs.append((length, used[length], used[length] + n * each, container, each))
            used[length] += n * each
        container += n
    runs.sort()
    return pd.DataFrame(runs, columns=["length", "first", "last", "container", "each"], dtype="int64"), container


def items_of(df: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, part_no from 1, start_token, end_token, n_tokens): a text longer than a container is cut, others are whole."""
    cuts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / capacity).cast("long"))
    parts = df.where(F.col("n_tokens") > 0).select("doc_id", "n_tokens", F.explode(cuts).alias("i"))
    end = F.least((F.col("i") + 1) * capacity, F.col("n_tokens"))
    return parts.select(
        "doc_id",
        (F.col("i") + 1).cast("int").alias("part_no"),
        (F.col("i") * capacity).alias("start_token"),
        end.alias("end_token"),
        (end - F.col("i") * capacity).alias("n_tokens"),
    )


def pack(df: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_id, doc_id, part_no, start_token, end_token, n_tokens): every token of every text in one container.

    No container holds more than ``capacity`` tokens.  Null and empty texts have no tokens and are in none; equal
    texts and repeated ids are separate items.  Only a text with more tokens than the capacity is cut, into full
    containers and a rest.  Items of one length are numbered by bucket and within, so a length that a third of all
    items has is spread over many tasks.
    """
    counted = with_tokens(df.select("doc_id", "text"), "text", vocabulary)
    items = materialize(items_of(counted, capacity), "items")
    histogram = {r["n_tokens"]: r["n"] for r in items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    runs, _ = plan(histogram, capacity)
    base = runs["first"].to_numpy() + runs["length"].to_numpy() * (1 << 40)  # ascending as the runs are
    first, container, each = (runs[c].to_numpy() for c in ("first", "container", "each"))

    @F.pandas_udf(T.LongType())
    def place(length: pd.Series, seq: pd.Series) -> pd.Series:
        i = np.searchsorted(base, length.to_numpy() * (1 << 40) + seq.to_numpy(), side="right") - 1
        return pd.Series(container[i] + (seq.to_numpy() - first[i]) // each[i])

    numbered = with_offsets(items, ["n_tokens"], ["doc_id", "part_no"], F.lit(0), buckets=64)
    return numbered.select(
        place(F.col("n_tokens"), F.col("seq")).alias("container_id"), "doc_id", "part_no", "start_token", "end_token", "n_tokens"
    )


def fill(df: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(used_tokens, n_containers): how many containers hold so many tokens; at most capacity rows."""
    per = pack(df, capacity, vocabulary).groupBy("container_id").agg(F.sum("n_tokens").alias("used_tokens"))
    return per.groupBy("used_tokens").agg(F.count(F.lit(1)).alias("n_containers"))

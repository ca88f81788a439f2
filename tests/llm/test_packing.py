import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import packing
from rankloom.llm.tokens import encoder


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_holds_every_item_once_within_capacity(lengths):
    runs, n = packing.plan(Counter(lengths), 40)
    used = np.zeros(n, int)
    seen = Counter()
    for length, first, last, container, each in runs.itertuples(index=False):
        for i in range(first, last):
            used[container + (i - first) // each] += length
            seen[length] += 1
    assert seen == Counter(lengths) and (used <= 40).all() and (used > 0).all()
    # no two containers could be one
    two = sorted(used)[:2]
    assert len(two) < 2 or sum(two) > 40


def test_exact_complements_first():
    counts = np.zeros(101, np.int64)
    for length, n in {100: 2, 60: 3, 40: 2, 50: 5, 30: 1, 10: 1}.items():
        counts[length] = n
    found = dict(packing.exact_patterns(counts, 100))
    assert found == {(100,): 2, (60, 40): 2, (50, 50): 2, (60, 30, 10): 1} and counts.sum() == 1


def test_triples_of_equal_lengths():
    counts = np.zeros(31, np.int64)
    counts[10] = 8
    assert packing.exact_patterns(counts, 30) == [((10, 10, 10), 2)] and counts[10] == 2


def test_operator(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma", "水", "été"]) for _ in range(rnd.randint(1, 90))) for _ in range(120)] + ["one two"] * 80 + ["w " * 500, "", None]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, seq string, n_tokens int")
    got = packing.pack(df, 100).collect()
    load, parts = Counter(), {}
    for r in got:
        load[r["container_id"]] += r["n_tokens"]
        assert r["n_tokens"] == r["end_token"] - r["start_token"]
        parts.setdefault(r["doc_id"], []).append((r["start_token"], r["end_token"]))
    assert max(load.values()) <= 100
    e = encoder()
    for i, t in enumerate(texts):
        n = len(e.encode_ordinary(t)) if t else 0
        spans = sorted(parts.get(i, []))
        if n and i:
            assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
            assert n > 100 or len(spans) == 1
        assert n or not spans
    assert len(parts[0]) == 2
    total = sum(load.values())
    assert len(load) <= -(-total // 100) + 2
    assert packing.pack(df.limit(0), 100).count() == 0


@pytest.mark.parametrize("n", [1, 7])
def test_single_lengths(n):
    runs, containers = packing.plan({2048: n})
    assert containers == n and len(runs) == 1

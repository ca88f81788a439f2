import numpy as np
import pytest

from rankloom.llm import mixture as X

DOC = "doc_id long, text string, source string, before long, block long"


def test_quotas():
    s = {q.source: q for q in X.quotas([("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.1, 9), ("d", 0.2, 0)], {"a": 10_000, "b": 1000}, 10)}
    # b can give 3,000 tokens at most, so a gives 3,750; c has nothing and d may not be used
    assert (s["a"].quota, s["b"].quota, s["c"].quota, s["d"].quota) == (375, 300, 0, 0)
    s = {q.source: q for q in X.quotas([("a", 0.5, 1), ("b", 0.5, 2)], {"a": 1000, "b": 100}, 10, total=800)}
    assert (s["a"].quota, s["b"].quota) == (60, 20)
    assert X.quotas([], {}) == [] and X.quotas([("a", None, None)], {"a": 5})[0].quota == 0


def test_shards_share_out_the_quotas():
    colors, size = np.array([700, 200, 0, 77]), 64
    shards = -(-int(colors.sum()) // size)
    parts = [X.shard_counts(i, shards, size, colors, 5) for i in range(shards)]
    total = np.zeros(4, int)
    for own, before in parts:
        assert (before == total).all() and own.sum() <= size and (own >= 0).all()
        total += own
    assert (total == colors).all()
    assert len({tuple(own) for own, _ in parts}) > 3  # drawn, not dealt out


def test_stretches_share_out_any_total():
    for colors in (np.array([700, 200, 0, 77]), np.array([7 * 10**12, 3 * 10**9, 0, 5])):
        parts = [X.stretch_counts(i, 13, colors, 5) for i in range(13)]
        total = np.zeros(4, np.int64)
        for own, before in parts:
            assert (before == total).all() and (own >= 0).all()
            total += own
        assert (total == colors).all() and all(abs(own[0] - colors[0] / 13) < 8 * (colors[0] / 13) ** 0.5 for own, _ in parts)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 1000])
def test_permutation(n):
    i = np.arange(n)
    a, b = X.permuted(i, n, np.full(n, 3)), X.permuted(i, n, np.full(n, 4))
    assert sorted(a) == sorted(b) == list(range(n))
    assert n < 10 or (a != b).any()


def test_operator(spark):
    rows = [(i, f"word{i} " * (5 + i % 40), "big" if i % 3 else "mid", 1, 1) for i in range(200)] + [(1000 + i, "tiny text here", "small", 1, 1) for i in range(9)]
    rows += [(2000, None, "big", 1, 1), (2001, "", "mid", 1, 1), (2002, "no source", None, 1, 1), (2003, "not wanted", "other", 1, 1)]
    df = spark.createDataFrame(rows, DOC)
    target = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 2), ("small", 0.1, 4), ("none", 0.2, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    m = X.Mixture(df, target, block=8, shard_blocks=5)
    got = m.rows().collect()
    assert {r["source"] for r in got} == {"big", "mid", "small"}
    use = {}
    for r in got:
        for t in range(r["start_token"], r["end_token"]):
            use[r["doc_id"], t] = use.get((r["doc_id"], t), 0) + 1
    most = {"big": 1, "mid": 2, "small": 4}
    source = {r[0]: r[2] for r in rows}
    assert all(n <= most[source[d]] for (d, _), n in use.items())
    per_slot = {}
    for r in got:
        per_slot[r["shard"], r["slot"]] = per_slot.get((r["shard"], r["slot"]), 0) + r["end_token"] - r["start_token"]
    assert max(per_slot.values()) <= 8
    assert "BroadcastExchange" not in m.rows()._jdf.queryExecution().executedPlan().toString().split("MapInPandas")[0]
    shares = {r["source"]: r for r in m.reached().collect()}
    assert shares["none"]["tokens_taken"] == 0 and shares["none"]["reached_share"] == 0.0
    for s, w in (("big", 0.6), ("mid", 0.3), ("small", 0.1)):
        assert abs(shares[s]["reached_share"] - w) < 0.03
    again = X.Mixture(df, target, block=8, shard_blocks=5).rows().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_empty(spark):
    df = spark.createDataFrame([(1, "a", "s", 1, 1)], DOC).limit(0)
    target = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert X.Mixture(df, target).rows().count() == 0 and X.Mixture(df, target).reached().first()["reached_share"] == 0.0
    assert X.Mixture(df, target.limit(0)).rows().count() == 0

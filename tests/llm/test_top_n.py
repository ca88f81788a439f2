import random

import pytest

from rankloom.llm.top_n import top_n

SCHEMA = "run string, grp string, score double, pid long, pos string"


def brute(rows, n):
    groups = {}
    for run, g, s, p, _ in rows:
        if s is not None and s == s and abs(s) != float("inf"):
            groups.setdefault((run, g), []).append((-s, p))
    return sorted(((*k, i + 1, p) for k, v in groups.items() for i, (_, p) in enumerate(sorted(v)[:n])), key=str)


@pytest.mark.parametrize("bands", [1, 2, 4, 24])
def test_against_brute_force(spark, bands):
    rnd = random.Random(bands)
    score = lambda: rnd.choice([None, float("nan"), float("inf"), float("-inf"), 0.5, 0.5, rnd.random(), -rnd.random()])
    rows = [(rnd.choice(["a", "b", None]), f"g{rnd.randint(0, 30)}" if rnd.random() > 0.4 else "hot", score(), i, "x") for i in range(3000)]
    got = top_n(spark.createDataFrame(rows, SCHEMA), ["run", "grp"], "score", ["pid"], 5, bands)
    assert sorted(((r["run"], r["grp"], r["pos"], r["pid"]) for r in got.collect()), key=str) == brute(rows, 5)


def test_all_tied_in_one_group(spark):
    df = spark.range(20_000).selectExpr("'r' run", "'g' grp", "1.0D score", "id pid", "'x' pos")
    assert [r["pid"] for r in top_n(df, ["run", "grp"], "score", ["pid"], 5).orderBy("pos").collect()] == [0, 1, 2, 3, 4]


def test_empty(spark):
    df = spark.createDataFrame([("a", "g", None, 1, "x"), ("a", "g", float("nan"), 2, "x")], SCHEMA)
    assert top_n(df, ["run", "grp"], "score", ["pid"], 5).count() == 0
    assert top_n(df.limit(0), ["run", "grp"], "score", ["pid"], 5).count() == 0

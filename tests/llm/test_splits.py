import random

from rankloom.llm import splits
from rankloom.llm.bare import bare_text

SCHEMA = "example_id long, query_id string, query string, label string, node string"


def brute(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    facts = []
    for i, (_, qid, query, *_rest) in enumerate(rows):
        q, b = (qid or "").strip(), bare_text(query)
        for n in ([("id", q)] if q else []) + ([("q", b)] if b else []):
            parent[find(("row", i))] = find(n)
        facts.append((find(("row", i)), q))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(("row", i)), []).append(i)
    return [(m, {facts[i][1] for i in m}) for m in groups.values()]


def test_against_union_find(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, " ", f"id{rnd.randint(0, 60)}", f" id{rnd.randint(0, 60)} "]), rnd.choice([None, "?", f"Q {rnd.randint(0, 150)}", f"q{rnd.randint(0, 150)}!"]), "x", "y") for i in range(300)]
    # a long chain, whose ends are far apart
    rows += [(1000 + i, f"c{i // 2}", f"chain {(i + 1) // 2}", "x", "y") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = set()
    for members, ids in brute(rows):
        if len(ids) > 1 and ids - {""}:
            expected |= {(min(ids - {""}), rows[i][0]) for i in members}
    assert {tuple(r) for r in splits.groups_found(df).collect()} == expected
    got = {r["example_id"]: r["split"] for r in splits.assign_splits(df).collect()}
    assert len(got) == len(rows)
    assert all(len({got[rows[i][0]] for i in m}) == 1 for m, _ in brute(rows))


def test_shares_with_a_hot_group(spark):
    rows = [(i, "hot" if i < 1000 else f"g{i // 3}", f"question {i}", "x", "y") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    n = {}
    for r in splits.assign_splits(df).collect():
        n[r["split"]] = n.get(r["split"], 0) + 1
    assert abs(n["train"] - 2400) < 60 and abs(n["validation"] - 300) < 30 and abs(n["test"] - 300) < 30


def test_empty_and_lonely(spark):
    df = spark.createDataFrame([(1, None, None, "x", "y"), (2, " ", "!", "x", "y")], SCHEMA)
    assert splits.groups_found(df).count() == 0
    assert sorted(r["example_id"] for r in splits.assign_splits(df).collect()) == [1, 2]
    assert splits.groups_found(df.limit(0)).count() == 0 and splits.assign_splits(df.limit(0)).count() == 0

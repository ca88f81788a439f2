import random

import pandas as pd

from rankloom.llm import overlap
from rankloom.llm.bare import bare_doc, bare_text

SCHEMA = "example_id long, split string, dataset string, query string, doc string, key string, rep long, t int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def near(a, b):
    return a == b or distance(a, b) * 5 <= max(len(a), len(b))


def brute(rows):
    good = [(i, s, bare_text(q), bare_doc(d)) for i, s, _, q, d, *_ in rows if s in ("train", "dev", "test")]
    good = [r for r in good if r[2] and r[3]]
    return {(min(a[0], b[0]), max(a[0], b[0])) for a in good for b in good if a[1] == "train" and b[1] != "train" and near(a[2], b[2]) and near(a[3], b[3])}


def edited(rnd, s, n):
    s = list(s)
    for _ in range(n):
        i = rnd.randrange(len(s))
        kind = rnd.random()
        if kind < 0.4:
            s[i] = rnd.choice("abcdefgh")
        elif kind < 0.7 and len(s) > 1:
            del s[i]
        else:
            s.insert(i, rnd.choice("abcdefgh"))
    return "".join(s)


def made(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randint(3, 8)))
    rows = []
    for k in range(n):
        q, d = " ".join(word() for _ in range(8)), " ".join(word() for _ in range(rnd.randint(8, 60)))
        if k % 3 == 0:
            d = "".join(rnd.choice("密集备份会经常修剪货架年度图片拒绝合同谁能重置平板下面空闲滤芯柜子说确认即可") for _ in range(rnd.randint(30, 200)))
        for _ in range(rnd.randint(1, 4)):
            rows.append((len(rows), rnd.choice(["train", "dev", "test", "train", None, "other"]), rnd.choice(["a", "b", None]), edited(rnd, q, rnd.randint(0, 3)), edited(rnd, d, rnd.randint(0, len(d) // 25)), "k", 1, 2))
    rows += [(9000 + i, s, "a", q, d, "k", 1, 2) for i, (s, q, d) in enumerate([("train", None, "x"), ("dev", "x", None), ("dev", "!", "x"), ("train", "q", ""), ("test", "q", "...")])]
    rows += [(9100, "train", "a", "One question", "Title: aaa bbb, text: ccc ddd", "k", 1, 2), (9101, "test", "a", "one QUESTION?", "text: CCC ddd; title: aaa-bbb", "k", 1, 2)]
    return rows


def test_against_brute_force(spark):
    rows = made(3)
    expected = brute(rows)
    found = overlap.cross_split_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {tuple(r) for r in found}
    assert len(got) == len(found) and got <= expected and len(got) >= 0.98 * len(expected) and (9100, 9101) in got
    report = overlap.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r["n_pairs"] for r in report) == len(got)


def test_large_tiles_lose_nothing(spark, monkeypatch):
    """One query with many docs, one doc under many queries: divided into small parts, the pairs are the same."""
    doc = "the same long passage stands under every query of this table and is near itself only"
    rnd = random.Random(8)
    rows = []
    for i in range(60):
        q = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40))
        rows += [(2 * i, "train", "a", q, doc, "k", 1, 2), (2 * i + 1, "dev", "a", q + "x", doc + "s", "k", 1, 2)]
    for i in range(60):
        d = "".join(rnd.choice("abcdefghijklmnop") for _ in range(120))
        rows += [(1000 + 2 * i, "train", "a", "one query", d, "k", 1, 2), (1001 + 2 * i, "dev", "a", "one query!", replaced(rnd, d, 0.1), "k", 1, 2)]
    whole = {tuple(r) for r in overlap.cross_split_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    monkeypatch.setattr(overlap, "PAIRS_OF_TILE", 50)
    monkeypatch.setattr(overlap, "ROWS_OF_TILE", 30)
    monkeypatch.setattr(overlap, "_BLOCK", 64)
    got = {tuple(r) for r in overlap.cross_split_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == whole == brute(rows) and len(got) == 120


def test_empty(spark):
    df = spark.createDataFrame(made(1, 2), SCHEMA)
    assert overlap.cross_split_pairs(df.limit(0)).count() == 0 and overlap.report(df.limit(0)).count() == 0


def replaced(rnd, s, share):
    """s with that share of its characters replaced, the places spread over all of it."""
    s, n = list(s), int(len(s) * share)
    for i in range(n):
        at = (2 * i + 1) * len(s) // (2 * n)
        s[at] = rnd.choice([c for c in "qrstuvwxyz" if c != s[at]])
    return "".join(s)


SCRIPTS = {
    "latin": "etaoinshrdlucmfwypvbgkjqxz",
    "cjk": "".join(chr(0x4E00 + 7 * i) for i in range(800)),
    "cyrillic": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэф",
}


def edits(rnd, s, share, letters):
    """s with that share of its length in substitutions, insertions and deletions at random places."""
    s = list(s)
    for _ in range(int(len(s) * share)):
        i, kind = rnd.randrange(len(s)), rnd.randrange(3)
        if kind == 0:
            s[i] = rnd.choice(letters)
        elif kind == 1:
            del s[i]
        else:
            s.insert(i, rnd.choice(letters))
    return "".join(s)


def test_recall_by_edit_rate(spark):
    """Docs of 10 to 3,000 characters, edits at random places or evenly spread, up to the limit: at least 0.95 found."""
    rnd, rows, of = random.Random(21), [], {}
    for share in (0.05, 0.1, 0.15, 0.2):
        for letters in SCRIPTS.values():
            for n in (10, 15, 20, 25, 31, 40, 80, 150, 300, 600, 3000):
                for spread in (True, False) * (3 if n < 1000 else 1):
                    q, d = "".join(rnd.choice(letters) for _ in range(20)), "".join(rnd.choice(letters) for _ in range(n))
                    other = replaced(rnd, d, share) if spread else edits(rnd, d, share, letters)
                    rows += [(len(rows), "train", "a", q, d, "k", 1, 2), (len(rows) + 1, "dev", "a", edits(rnd, q, 0.15, letters), other, "k", 1, 2)]
                    if n == 3000 or near(rows[-2][4], other):
                        of.setdefault((share, spread), set()).add((len(rows) - 2, len(rows) - 1))
    got = {tuple(r) for r in overlap.cross_split_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    recall = {k: len(v & got) / len(v) for k, v in of.items()}
    print(recall)
    assert min(recall.values()) >= 0.9 and len(set().union(*of.values()) & got) >= 0.95 * len(set().union(*of.values())), recall


def test_short_docs_with_separate_edits(spark):
    rows = [(1, "train", "a", "one question", "abcdefghij", "k", 1, 2), (2, "dev", "a", "one question", "abXdefgYij", "k", 1, 2)]
    assert [tuple(r) for r in overlap.cross_split_pairs(spark.createDataFrame(rows, SCHEMA)).collect()] == [(1, 2)]


def test_queries_of_one_template_are_compared_once(monkeypatch):
    """Pairs come in the first bucket they share only, all that can be near, whether compared one by one or as blocks."""
    rnd = random.Random(21)
    word = lambda n: "".join(rnd.choice("bdfgklmn") + rnd.choice("aeiou") for _ in range(n))
    texts = sorted({f"whydoesthe{word(4)}{rnd.choice(['tablet', 'river', 'ledger'])}stopafterthe{rnd.choice(['update', 'refund'])}" for _ in range(160)})
    texts += ["x" + t for t in texts[:20]] + ["".join(map(chr, range(97, 123))) * 3, "".join(map(chr, range(97, 123))) * 3 + "z"]
    keys, sketch = overlap.QUERY.keys(texts), overlap._sketch.func(pd.Series(texts))
    rows = [(int(k), g, i % 2, i, len(t), sketch[i], t) for i, t in enumerate(texts) for g, k in enumerate(keys[i])]
    b = pd.DataFrame(rows, columns=["tile", "band", "e", "id", "len", "sketch", "s"]).sort_values("tile", kind="stable")
    far = lambda s, t: overlap.edit_distance(s, t, max(len(s), len(t))) > max(len(s), len(t)) // 5
    near = {(i, j) for i, s in enumerate(texts) for j, t in enumerate(texts) if i % 2 and not j % 2 and set(keys[i]) & set(keys[j]) and not far(s, t)}
    assert len(near) > 20
    for least in (1, 10**9):
        monkeypatch.setattr(overlap, "_STRETCH", least)
        got = [tuple(r) for x in overlap._compared(b) for r in x.itertuples(index=False)]
        assert len(got) == len(set(got)) and near <= set(got)

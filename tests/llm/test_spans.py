import random

from rankloom.llm import spans

DOC = "doc_id long, text string, key string, h long, pos int, len int"


def brute(rows, least):
    first = {}
    for i, t in rows:
        for j in range(len(t or "") - least + 1):
            first.setdefault(t[j : j + least], set()).add(i)
    out = set()
    for i, t in dict(rows).items():
        run = None
        for j in range(len(t or "") - least + 1):
            if len(first[t[j : j + least]]) > 1:
                if run and run[1] >= j:
                    run[1] = j + least
                else:
                    if run:
                        out.add((i, *run))
                    run = [j, j + least]
        if run:
            out.add((i, *run))
    return out


def made(seed, n):
    rnd = random.Random(seed)
    text = lambda k: "".join(rnd.choice("abcdefgh 水火木金土") for _ in range(k))
    shared = [text(rnd.randint(90, 260)) for _ in range(12)]
    header = text(70)
    rows = []
    for i in range(n):
        parts = [text(rnd.randint(0, 150))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randint(0, 40)
            parts += [s[a : len(s) - rnd.randint(0, 40)], text(rnd.randint(0, 60))]
        t = "".join(parts)
        rows.append((i, header + t if i % 2 else t))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, None), (n + 3, ""), (n + 4, "x" * 99), (n + 5, "ab" * 300), (n + 6, "ab" * 70), (n + 7, shared[0] + shared[0])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, 3) for i, t in rows], DOC)


def test_against_brute_force(spark, monkeypatch):
    rows = made(1, 80)
    expected = brute(rows, 100)
    assert len(expected) > 60
    assert {tuple(r) for r in spans.shared_spans(frame(spark, rows)).collect()} == expected
    # the way for seeds with many different surroundings gives the same
    monkeypatch.setattr(spans, "COMPARED", 2)
    assert {tuple(r) for r in spans.shared_spans(frame(spark, rows)).collect()} == expected


def test_repeated_id_is_one_record(spark):
    t = "".join(random.Random(4).choice("abcdef") for _ in range(300))
    assert spans.shared_spans(frame(spark, [(1, t), (1, t)])).count() == 0
    assert sorted(map(tuple, spans.shared_spans(frame(spark, [(1, t), (1, t), (2, t)])).collect())) == [(1, 0, 300), (2, 0, 300)]


def test_amounts_and_empty(spark):
    t = "".join(random.Random(5).choice("abcdef") for _ in range(150))
    got = {r["doc_id"]: (r["n_chars"], r["shared_chars"], r["n_spans"]) for r in spans.shared_amount(frame(spark, [(1, t + "zz"), (2, "yy" + t), (3, None)])).collect()}
    assert got == {1: (152, 150, 1), 2: (152, 150, 1), 3: (0, 0, 0)}
    assert spans.shared_spans(frame(spark, [(1, t)]).limit(0)).count() == 0 and spans.passages(frame(spark, [(1, t)]).limit(0)).count() == 0


def test_selected_seeds_are_shared():
    rnd = random.Random(6)
    text = lambda k: "".join(rnd.choice("abcdefgh") for _ in range(k))
    for _ in range(30):
        s = text(100)
        a, b = text(rnd.randint(0, 200)) + s + text(50), text(rnd.randint(0, 200)) + s + text(90)
        d, pos, h, _ = spans.seeds_of([a, b])
        at = [{(int(x), int(p) - (a, b)[k].index(s)) for dd, p, x in zip(d, pos, h) if dd == k} for k in (0, 1)]
        assert any(0 <= p <= 60 for _, p in at[0] & at[1])


def test_chain():
    exact = [(i * 30, 500 + i * 30) for i in range(6)]
    noise = [(40, 3000), (100, 10)]
    got = spans.chain(exact + noise, k=40)
    assert got[0][:4] == (0, 190, 500, 690) and got[0][4] == 190.0
    # a gap costs, crossed matches don't chain
    apart = spans.chain([(0, 0), (100, 110)], k=80)
    assert apart[0][:4] == (0, 180, 0, 190) and apart[0][4] == 160 - 0.1 * (20 + 30)
    assert all(c[1] - c[0] == 120 for c in spans.chain([(0, 500), (300, 0)], k=120))
    assert spans.chain([]) == []


def test_fuzzy_passages(spark):
    rnd = random.Random(7)
    text = lambda k: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(k))
    s = text(600)
    t = list(s)
    for i in range(50, 600, 90):
        t[i] = "#"
    rows = [(1, text(100) + s + text(100)), (2, text(333) + "".join(t)), (3, text(700))]
    got = spans.passages(frame(spark, rows)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["doc_a"], r["doc_b"]) == (1, 2) and r["end_a"] - r["start_a"] > 500 and abs((r["start_b"] - r["start_a"]) - 233) <= 1 and r["identity"] > 0.97


def test_passages_of_texts_that_share_more_than_the_first_ones(spark):
    """Six documents hold one part each, two hold all six; two share a stretch whose halves stood elsewhere before."""
    rnd = random.Random(9)
    text = lambda k: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(k))
    parts = [text(300) for _ in range(6)]
    rows = [(i + 1, text(50) + p + text(50)) for i, p in enumerate(parts)]
    rows += [(100, text(40) + "".join(parts) + text(40)), (101, text(90) + "".join(parts) + text(20))]
    s = text(360)
    rows += [(200, text(80) + s[:180] + text(80)), (201, text(60) + s[180:] + text(90)), (202, text(30) + s + text(99)), (203, text(77) + s + text(44))]
    got = {(r["doc_a"], r["doc_b"]): r for r in spans.passages(frame(spark, rows)).collect()}
    whole = got[100, 101]
    assert whole["start_a"] <= 40 + 60 and whole["end_a"] >= 40 + 1800 - 60 and whole["identity"] == 1.0
    assert all((i + 1, 100) in got and (i + 1, 101) in got for i in range(6))
    both = got[202, 203]
    assert both["end_a"] - both["start_a"] >= 300 and both["identity"] == 1.0


def test_recall_of_passages(spark):
    """Every pair of texts that share 150 characters is linked, directly or through a text they both share a passage with."""
    rnd = random.Random(10)
    text = lambda k: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(k))
    pool = [text(400) for _ in range(8)]
    rows = []
    for i in range(60):
        p, q = rnd.choice(pool), rnd.choice(pool)
        a, b = rnd.randint(0, 200), rnd.randint(0, 200)
        rows.append((i, text(rnd.randint(0, 90)) + p[a : a + 200] + text(30) + q[b : b + 160]))
    grams = [{t[x : x + 150] for x in range(len(t) - 149)} for _, t in rows]
    true = {(i, j) for i in range(60) for j in range(i + 1, 60) if grams[i] & grams[j]}
    linked = {(r["doc_a"], r["doc_b"]) for r in spans.passages(frame(spark, rows)).collect()}
    near = {i: {a if b == i else b for a, b in linked if i in (a, b)} for i in range(60)}
    found = {(i, j) for i, j in true if (i, j) in linked or near[i] & near[j]}
    print(len(true), len(true & linked), len(found))
    assert len(true) > 100 and len(found) >= 0.98 * len(true)


def test_passages_of_all_pairs(spark, monkeypatch):
    """Every two ids whose texts share 100 characters have a passage that holds them, also ids of equal texts, however tiles are cut."""
    rnd = random.Random(12)
    text = lambda k: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(k))
    pool = [text(300) for _ in range(5)]
    rows = []
    for i in range(40):
        p, q = rnd.choice(pool), rnd.choice(pool)
        a, b = rnd.randint(0, 60), rnd.randint(0, 60)
        rows.append((i * 7 % 41, text(rnd.randint(1, 90)) + p[a : a + rnd.randint(110, 150)] + text(30) + q[b : b + rnd.randint(60, 150)]))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (101, rows[5][1]), (102, text(200)), (103, text(100)), (104, None)]
    rows += [(105, rows[-2][1])]
    texts = {i: t for i, t in rows if t}
    grams = {i: {t[x : x + 100]: x for x in range(len(t) - 99)} for i, t in texts.items()}
    true = {(i, j, g) for i in texts for j in texts if i < j for g in grams[i].keys() & grams[j].keys()}
    pairs = {(i, j) for i, j, _ in true}
    assert len(pairs) > 150 and {(35, 100), (100, 101), (103, 105)} <= pairs
    seen = []
    for docs in (1_500, 3):
        monkeypatch.setattr(spans, "DOCS_OF_TILE", docs)
        got = [tuple(r) for r in spans.passages(frame(spark, rows)).collect()]
        assert len(got) == len(set(got))
        at = {}
        for r in got:
            at.setdefault(r[:2], []).append(r)
        assert all(r[0] < r[1] and r[6] >= 100 for r in got)
        lost = [(i, j) for i, j, g in true if not any(s <= grams[i][g] and grams[i][g] + 100 <= e and p <= grams[j][g] and grams[j][g] + 100 <= q for _, _, s, e, p, q, *_ in at.get((i, j), []))]
        assert not lost
        seen.append(set(got))
    assert seen[0] == seen[1]


def test_stretches_and_chains_with_lengths():
    rnd = random.Random(13)
    s = "".join(rnd.choice("abcdefgh") for _ in range(300))
    a, b = "x" + s[:120] + s[119:240], "yy" + s[:240]
    t = spans._Texts([a, b], 24, 48)
    h = [{int(x): int(p) for r, p, x in zip(t.row, t.pos, t.h) if r == k} for k in (0, 1)]
    both = sorted(h[0].keys() & h[1].keys())
    places = [spans.np.array([d[x] for x in both]) for d in h]
    zero = spans.np.zeros(len(both), int)
    got = t.chains(zero, zero + 1, *places, 0.1, 100)
    assert [tuple(map(float, r)) for r in got] == [(0, 1, 1, 242, 2, 242, 240 - 0.1, round(1 - 1 / 241, 4))]


def test_chain_keeps_what_another_chain_left():
    # the second and third stretch both follow the first; the one left over has 110 characters by itself
    got = spans.chain([(0, 0, 500), (600, 600, 300), (610, 900, 110)], gap=0.1)
    assert sorted(c[:4] for c in got) == [(0, 900, 0, 900), (610, 720, 900, 1010)]

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm.chunks import cut, split_oversized


def prose(seed, n):
    rnd = random.Random(seed)
    out = ""
    while len(out) < n:
        out += " ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(3, 14))) + rnd.choice([". ", "! ", "。", ".\n\n", ", "])
    return out[:n]


def check(text, limit, overlap):
    pieces = cut(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b, o), (a2, b2, o2) in zip(pieces, pieces[1:]):
        assert a < a2 <= b < b2 and o2 == b - a2  # each piece begins within the one before it and goes on after it
    assert all(0 < b - a <= limit for a, b, _ in pieces)
    # the new parts put together are the text
    assert "".join(text[a + o : b] for a, b, o in pieces) == text
    return pieces


def test_short_and_empty():
    assert cut("", 1200, 120) == [] and cut("x" * 1200, 1200, 120) == [(0, 1200, 0)] and len(cut("x" * 1201, 1200, 120)) == 2


@settings(max_examples=60, deadline=None)
@given(st.text("ab .\n。，", min_size=1201, max_size=6000))
def test_any_text(text):
    check(text, 1200, 120)


def test_overlaps_and_boundaries():
    text = prose(1, 20_000)
    pieces = check(text, 1200, 120)
    assert all(80 <= o <= 160 for _, _, o in pieces[1:])
    assert all(text[b - 1] in " \n。" for _, b, _ in pieces[:-1])


def test_without_any_boundary():
    rnd = random.Random(3)
    check("".join(rnd.choice("abc") for _ in range(9000)), 1200, 120)
    check("a" * 9000, 1200, 120)


def test_an_edit_moves_only_neighbours():
    text = prose(2, 30_000)
    edited = text[:15_000] + "an inserted sentence. " + text[15_000:]
    old = {text[a:b] for a, b, _ in cut(text)}
    new = {edited[a:b] for a, b, _ in cut(edited)}
    assert len(new - old) <= 4 and len(old & new) >= len(old) - 4


def test_operator(spark):
    long = prose(4, 5000)
    df = spark.createDataFrame([(1, long, "x"), (1, long, "y"), (2, "short", "z"), (3, None, "z"), (None, long, "z"), (4, "", "z")], "i long, t string, piece string")
    got = split_oversized(df, "i", "t").collect()
    assert {r["i"] for r in got} == {1, None} and all(len(r["piece"]) <= 1200 and r["piece"] == long[r["start_pos"] : r["end_pos"]] for r in got)
    assert len([r for r in got if r["i"] == 1]) == 2 * len(cut(long))
    assert split_oversized(df.limit(0), "i", "t").count() == 0

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.operators.packed import parse_packed, unpack

CASES = [
    (None, []),
    ("", []),
    ("  \t", []),
    ("a,b", ["a", "b"]),
    ("，a、b；c|d\r\ne", ["a", "b", "c", "d", "e"]),
    ("'R w, EU' | 36 ; doc.v3", ["R w, EU", "36", "doc.v3"]),
    ('["63", "The \\"x\\" lamp", "\\u961f\\uff0c"]', ["63", 'The "x" lamp', "队，"]),
    ("['70', 'The \"w\" s']", ["70", 'The "w" s']),
    ('「The "loud" v」,4，kb/a/8; 10', ['The "loud" v', "4", "kb/a/8", "10"]),
    ('[{"turn_id": "D5:6"}, {"dialog_id": "D1:4"}, {"x":99, "y": null}]', ["D5:6", "D1:4", "99"]),
    ('"a ""b"" c",d', ['a "b" c', "d"]),
    ('"""a"" b";x', ['"a" b', "x"]),
    ('""; z', ["z"]),
    ("it's x", ["it", "s", "x"]),
    ('{"D1:2": true, "k": ["a", 3]}', ["a", "3"]),
    ("[12, 13.5]", ["12", "13.5"]),
    ("a a a", ["a", "a", "a"]),
    ("“x” ”y“ z", ["x", "y", "z"]),
    ("conv::D1:2\nsession_5:6;#7", ["conv::D1:2", "session_5:6", "#7"]),
]


@pytest.mark.parametrize(("text", "values"), CASES)
def test_one_by_one(text, values):
    assert parse_packed(pa.array([text], pa.string())).to_pylist() == [values]


def test_all_at_once_and_sliced():
    arr = pa.array([t for t, _ in CASES])
    assert parse_packed(arr).to_pylist() == [v for _, v in CASES]
    assert parse_packed(arr.slice(3, 9)).to_pylist() == [v for _, v in CASES[3:12]]
    assert parse_packed(pa.array([], pa.string())).to_pylist() == []
    assert parse_packed(pa.array([None, None], pa.string())).to_pylist() == [[], []]


BARE = st.text("abcXYZ019:._/#-", min_size=1, max_size=8)
QUOTED = st.text("ab ,;、|[]{}：队 9", min_size=1, max_size=8)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.booleans(), BARE, QUOTED, st.sampled_from(['""', "''", "“”", "「」", "«»"]), st.sampled_from([", ", ";", "，", " | ", "\n", "　；"])), max_size=8))
def test_round_trip(items):
    text, values = "x ", ["x"]
    for quoted, bare, inner, pair, sep in items:
        text += sep + (pair[0] + inner + pair[1] if quoted else bare) + " "
        values.append(inner if quoted else bare)
    assert parse_packed(pa.array([text, None, text])).to_pylist() == [values, [], values]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=6), st.integers(0, 999)), max_size=6))
def test_json_round_trip(values):
    import json

    text = json.dumps(values)
    expected = [str(v) for v in values if v != ""]
    assert parse_packed(pa.array([text])).to_pylist() == [expected]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab\"'“”「」\\[]{}:, ;null1", max_size=12), max_size=5))
def test_any_text_and_rows_by_themselves(texts):
    whole = parse_packed(pa.array(texts, pa.string())).to_pylist()
    assert whole == [parse_packed(pa.array([t])).to_pylist()[0] for t in texts]
    assert all(v for row in whole for v in row)


def test_a_backslash_ends_with_its_row():
    assert parse_packed(pa.array(["a\\", "'x;y' z", "\\", "';'"])).to_pylist() == [["a"], ["x;y", "z"], [], [";"]]


def test_unpack(spark):
    df = spark.createDataFrame([(1, "a,b", 9, "z"), (None, "c", 8, None), (1, "a,b", 9, "z"), (2, None, 7, "y"), (3, "  ", 7, "y")], "id long, value string, pos int, item string")
    got = sorted(map(tuple, unpack(df, ["id"], "value").collect()), key=str)
    assert got == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (None, 1, "c")]
    assert unpack(df.limit(0), ["id"], "value").count() == 0


def test_very_long(spark):
    text = ";".join(f'"v {i}"' if i % 2 else f"b{i}" for i in range(5000))
    assert parse_packed(pa.array([text])).to_pylist()[0] == [f"v {i}" if i % 2 else f"b{i}" for i in range(5000)]

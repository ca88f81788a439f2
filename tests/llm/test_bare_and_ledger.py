from rankloom.llm import ledger
from rankloom.llm.bare import bare_doc, bare_text, named_fields

EX = "example_id long, query string, doc string, loaded_at timestamp, bucket string, key string, n int"


def rows(spark, data):
    return spark.createDataFrame([(i, q, d, None, "b", "k", 1) for i, q, d in data], EX)


def test_bare_text():
    assert bare_text(None) == bare_text("") == bare_text(" \t​ .,!—　") == ""
    assert bare_text("ＡＢＣ，１２３！") == "abc123" and bare_text("Straße") == "strasse" and bare_text("ﬁn²") == "fin2"
    assert bare_text("a​b­c") == "abc" and bare_text("É t é") == "été" and bare_text("℡①") == "tel1"


def test_bare_doc_orders_fields():
    forms = [
        "title: A b, content: C-d",
        "content: c d; Title: ab",
        "CONTENT: C D\nTITLE: A.B",
        '{"title": "A b", "content": "C d"}',
        '{ "content":"c,d", "Title":"ab" }',
        "content：Cd  title：A b",
    ]
    assert {bare_doc(f) for f in forms} == {"contentcdtitleab"}
    # a long ruler before the first name, much space before a colon
    assert bare_doc("=" * 90 + " title: a b, content" + " " * 40 + ": c d") == bare_doc("—" * 90 + "content: c d, title: A b") == "contentcdtitleab"
    # one field, an unknown name, or a name within a word or inside is plain text
    assert bare_doc("title: A b") == "titleab" and named_fields("see title: a, text: b") is None
    assert bare_doc('{"title": "A b"}') == "titleab" and bare_doc('{"title": "x", "other": "y"}') == "titlexothery"
    assert bare_doc("subtitle: a, context: b") == "subtitleacontextb"
    assert bare_doc("title: , text: .") == "" and bare_doc(None) == ""


def test_copies(spark):
    df = rows(spark, [(5, "A b", "C d."), (3, "ab!", "c  D"), (9, "AB", "CD"), (1, None, "cd"), (2, "ab", None), (4, "..", "cd"), (6, "ab", "cde"), (7, "q", "title: x, text: y"), (8, "Q", "TEXT: Y; TITLE: X")])
    assert sorted(map(tuple, ledger.copies(df).collect())) == [(3, 5), (3, 9), (7, 8)]
    assert sorted(map(tuple, ledger.records(df).collect())) == [(3, 3), (6, 1), (7, 2)]


def test_empty_and_hot(spark):
    assert ledger.copies(rows(spark, [(1, "a", "b")]).limit(0)).count() == 0
    data = [(i, "same", "text") for i in range(3000)] + [(10_000 + i, f"q{i}", "d") for i in range(3000)]
    got = ledger.copies(rows(spark, data)).collect()
    assert len(got) == 2999 and {r["keep_id"] for r in got} == {0}


def test_ledger_by_batches_in_any_order(spark):
    data = [(i, f"q{i % 7}", f"d{i % 3}") for i in range(100)]
    keys = ledger.canonical_keys(rows(spark, data))
    whole = ledger.Ledger(spark)
    whole.merge(keys)
    parts = ledger.Ledger(spark)
    for lo, hi in ((60, 100), (0, 10), (10, 60), (200, 300)):
        parts.merge(keys.where(f"example_id >= {lo} and example_id < {hi}"))
    show = lambda x: sorted((r["bucket"], bytes(r["key"]), r["n"], r["keep_id"]) for r in x.read().collect())
    assert show(whole) == show(parts) and len(show(whole)) == 21
    again = ledger.Ledger(spark, parts.path)
    assert show(again) == show(parts)


def test_old_versions_go_and_buckets_follow_size(spark, tmp_path, monkeypatch):
    keys = ledger.canonical_keys(rows(spark, [(i, f"q{i}", f"d{i % 3}") for i in range(400)]))
    one = ledger.Ledger(spark, str(tmp_path / "ledger"))
    for lo in range(0, 400, 100):
        one.merge(keys.where(f"example_id >= {lo} and example_id < {lo + 100}"))
    versions = sorted(p.name for p in (tmp_path / "ledger").glob("version=*"))
    state = one.state()
    assert len(versions) <= 2 and f"version={next(iter(state['at'].values()))}" in versions and state["buckets"] == 16
    assert not list((tmp_path / "ledger").glob("manifest-*")) and one.read().count() == 400
    monkeypatch.setattr(ledger, "KEYS_OF_BUCKET", 10)
    many = ledger.Ledger(spark)
    many.merge(keys)
    assert many.state()["buckets"] == 64 and many.read().count() == 400

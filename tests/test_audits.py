from cairn.functions import audits as A
from pyspark.sql import functions as F


def test_nulls_and_empty_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("x" * 100_000,)], "t string")
    for function in (A.labelled_values, A.quantities, A.literal_claims, A.named_hosts):
        assert [r[0] for r in df.select(function(F.col("t"))).collect()] == [[], [], []]
    assert [r["v"]["verdict"] for r in df.select(A.answer_verdict(F.col("t")).alias("v")).collect()] == ["fail", "fail", "review"]
    assert [r["w"]["line_no"] for r in df.select(A.anchor_window(F.col("t"), F.lit("5.2")).alias("w")).collect()] == [None] * 3


def test_values(spark):
    df = spark.createDataFrame([("size: 12MB, 温度：36% on 2024-05-01 and v5.2.1\nsee https://E.org/x",)], "t string")
    row = df.select(A.labelled_values(F.col("t")).alias("l"), A.quantities(F.col("t")).alias("q"), A.literal_claims(F.col("t")).alias("c"), A.named_hosts(F.col("t")).alias("h"), A.anchor_window(F.col("t"), F.lit("5.2.1")).alias("w")).first()
    assert [(p["label"], p["value"]) for p in row["l"]] == [("size", "12MB"), ("温度", "36%")]
    assert row["q"] == ["12MB", "36%"] and row["c"] == ["date:2024-05-01", "version:5.2.1"] and row["h"] == ["host:e.org"]
    assert row["w"]["line_no"] == 1 and row["w"]["lines"].count("\n") == 1


def test_calls_and_upserts(spark):
    calls = spark.createDataFrame([('{"tool": "a", "name": "b", "args": {"q": "1"}}',), ('{"name": "b"}',), ("broken",), (None,)], "c string")
    got = [tuple(r[0]) for r in calls.select(A.canonical_call(F.col("c"), ["tool", "name"], ["args.q"])).collect()]
    assert got == [("a", True, "1"), ("b", False, None), (None, False, None), (None, False, None)]
    df = spark.createDataFrame([("k", "old", 1), ("m", "old", 2)], "id string, v string, n int")
    changes = spark.createDataFrame([("k", "new"), ("x", "added"), ("m", None)], "id string, v string")
    assert {tuple(r) for r in A.upserted(df, changes, "id", "changed").collect()} == {("k", "new", 1, True), ("m", "old", 2, True), ("x", "added", None, True)}
    kinds = spark.createDataFrame([([], ["a:1"]), (["a:1"], ["a:1"]), (["a:1"], ["a:2"]), (["a:1"], ["b:1"])], "x array<string>, y array<string>")
    assert [r[0] for r in kinds.select(A.alignment(F.col("x"), F.col("y"))).collect()] == ["not_requested", "exact", "conflict", "unresolved"]


def test_quotes_packages_and_options(spark):
    df = spark.createDataFrame([("a" * 70 + " One. Two three four.",), ("x" * 200,), ("short",), (None,)], "t string")
    got = [r[0] for r in df.select(A.bounded_quote(F.col("t"), 72, 10)).collect()]
    assert got == ["a" * 70 + " One.", "x" * 72, "short", ""]
    names = spark.createDataFrame([("https://www.npmjs.com/package/@a/b?x=1",), ("latest npm left-pad version",), ("left-pad",), ("two words",), (None,)], "t string")
    assert [r[0] for r in names.select(A.package_name(F.col("t"), "npm")).collect()] == ["@a/b", "left-pad", "left-pad", "", ""]
    sites = spark.createDataFrame([("https://a.E.org/x", "site:e.org limits"), ("https://x.org", "site:e.org"), (None, "no site"), (None, "site:e.org")], "u string, q string")
    assert [r[0] for r in sites.select(A.site_allows(F.col("u"), F.col("q"))).collect()] == [True, False, True, False]
    options = spark.createDataFrame([(-8.0, 4, -1.0, 2.0)], "s double, n int, f double, q double")
    assert [options.select(A.option_score(*[F.col(c) for c in "snfq"], m)).first()[0] for m in ("sum", "mean", "sqrt_mean", "first", "query_sqrt_mean")] == [-8.0, -2.0, -4.0, -1.0, -2.0]


def test_json_leaves_and_bounds():
    from cairn.functions import jsontext as J

    assert J.leaf_texts({"a": [1, {"b": " x "}], "c": None, "d": ""}) == ["a", "1", "b", "x", "c", "d"] and J.leaf_texts(None) == []
    assert J.bounded({"a": "x" * 9, "b": [1, 2, 3], "c": {"d": {"e": 1}}}, items=2, chars=4, depth=2) == {"a": "xxxx", "b": [1, 2]}
    assert J.bounded({"c": {"d": {"e": 1}}}, depth=2) == {"c": {"d": '{"e":1}'}}


def test_page_chunks(spark):
    from cairn.operators import passages

    df = spark.createDataFrame([(1, " one two "), (2, None), (3, "a b c d.\n\ne f g h.\n\ni j k l.")], "id int, t string")
    got = [(r["id"], r["chunk_id"], r["chunk"]) for r in passages.page_chunk_rows(df, "t", 6, 4).collect()]
    assert (1, "chunk-1", "one two") in got and sum(r[0] == 3 for r in got) == 3 and not any(r[0] == 2 for r in got)

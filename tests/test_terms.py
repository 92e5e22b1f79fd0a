"""Terms, anchors and relevance on small cases."""

import pytest
from cairn.functions import terms as T
from pyspark.sql import functions as F


def value(spark, column, text, **more):
    df = spark.createDataFrame([(text, *more.values())], "t string" + "".join(f", {k} string" for k in more))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("function", [T.strip_operators, T.search_focus, T.fact_anchors, T.literal_anchors, T.plain_versions, T.locator_versions, T.action_families, T.topic_terms, T.compact_terms, T.latin_terms, T.signal_terms, T.quality_terms])
def test_null_empty_and_long_texts(spark, function):
    for text in (None, "", "   ", "\n"):
        assert not value(spark, function(F.col("t")), text)
    long = "planner cache " * 20_000
    assert value(spark, function(F.col("t")), long) is not None


def test_operators_and_focus(spark):
    assert value(spark, T.strip_operators(F.col("t")), "planner https://a.b/c?d=1 site:docs.example.org  limits") == "planner limits"
    assert value(spark, T.search_focus(F.col("t")), "Please find me the  planner limits") == "the planner limits"
    assert value(spark, T.search_focus(F.col("t")), "site:a.example search for planner limits") == "site:a.example planner limits"
    assert value(spark, T.search_focus(F.col("t")), "How do I retrieve a token?") == "How do I retrieve a token?"
    assert value(spark, T.search_focus(F.col("t")), "请帮我查找规划器的限制") == "规划器的限制"


def test_anchors(spark):
    assert value(spark, T.fact_anchors(F.col("t")), "RFC 9110 and cve-2026-12345 in v3.14.1 or 5.2, see https://x.y/1.2.3") == ["rfc9110", "cve-2026-12345", "3.14.1", "5.2"]
    assert value(spark, T.literal_anchors(F.col("t")), "Use --max-size with token_limit, a-b-c, camelCase and HTTP") == ["--max-size", "token_limit", "a-b-c", "camelcase", "http"]
    assert value(spark, T.locator_versions(F.col("t")), "https://e.org/django-5-2-released/v3_1/2024-05-01") == ["05.01", "3.1", "5.2"]
    check = lambda t, a: value(spark, T.contains_anchor(F.col("t"), F.col("a")), t, a=a)
    assert check("in v5.2 and", "5.2") and not check("in 15.2", "5.2") and not check("5.2.1", "5.2") and check("RFC 9110", "rfc9110") and check("x", "")
    assert value(spark, T.locator_contains(F.col("t"), F.col("a")), "/django-52-released", a="5.2")


def test_actions(spark):
    assert value(spark, T.action_families(F.col("t")), "How to install and run it?") == ["install", "run"]
    df = spark.createDataFrame([(["run"], ["start"]), (["run"], ["stop"]), ([], ["stop"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(T.actions_met(F.col("a"), F.col("b"))).collect()] == [True, False, True]


def test_relevance(spark):
    def found(title, snippet, url, query):
        df = spark.createDataFrame([(title, snippet, url, query)], "t string, s string, u string, q string")
        return df.select(T.relevance(F.col("t"), F.col("s"), F.col("u"), F.col("q")).alias("r")).first()["r"]

    assert found("Planner limits", "", "https://e.org/5.2", "planner limits in 5.2")["related"]
    assert found("Planner limits", "", "https://e.org/4.1", "planner limits in 5.2")["version_conflict"]
    assert not found("Gardening", "roses", "https://e.org", "planner limits of the cache")["related"]
    assert found(None, None, None, None)["related"]
    assert not found("Planner limits", "", "", "planner limits of token_limit")["related"] and found("token_limit", "", "", "planner limits of token_limit")["related"]


def test_body_and_noise(spark):
    s = value(spark, T.body_signal(F.col("t"), F.col("q")), "The planner keeps tokens", q="planner tokens cache")
    assert s["matched"] == ["planner", "tokens"] and s["signal"] == 0.6667
    df = spark.createDataFrame([("word meaning of find", ["planner"]), ("word meaning planner", ["planner"]), ("grammar", [])], "t string, w array<string>")
    assert [r[0] for r in df.select(T.is_noise(F.col("t"), F.col("w"))).collect()] == [True, False, False]

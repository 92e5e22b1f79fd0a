import random

import pytest
from cairn.llm import mixing as M


def table(spark, seed=3):
    r = random.Random(seed)
    rows = [(i, r.choice(["a"] * 8 + ["b"] * 3 + ["c"]), r.randint(1, 400)) for i in range(3000)]
    rows += [(5000, None, 10), (5001, "a", None), (5002, "a", 0), (5003, "unknown", 50), (None, "a", 5), rows[0], rows[0]]
    return spark.createDataFrame([(*x, "z") for x in rows], "doc_id bigint, source string, n_tokens bigint, copies string"), rows


def test_shares_and_caps(spark):
    docs, rows = table(spark)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("none", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix, shares = M.mix_sources(docs, "doc_id", "source", "n_tokens", targets)
    got = mix.collect()
    size = {i: n for i, _, n in rows}
    source = {i: s for i, s, _ in rows}
    assert len(got) == len({r["doc_id"] for r in got})
    most = {"a": 1, "b": 2, "c": 3}
    assert all(1 <= r["copies"] <= most[r["source"]] and source[r["doc_id"]] == r["source"] and size[r["doc_id"]] == r["n_tokens"] for r in got)
    total = sum(r["copies"] * r["n_tokens"] for r in got)
    for name, want in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        mine = sum(r["copies"] * r["n_tokens"] for r in got if r["source"] == name)
        assert mine / total == pytest.approx(want, abs=0.002)
    told = {r["source"]: r for r in shares.collect()}
    assert told["none"]["size"] == 0 and set(told) == {"a", "b", "c", "none"}
    assert sum(r["share"] for r in told.values()) == pytest.approx(1)
    assert {tuple(r) for r in M.mix_sources(docs, "doc_id", "source", "n_tokens", targets)[0].collect()} == {tuple(r) for r in got}


def test_total_below_what_is_there(spark):
    docs, _ = table(spark)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    mix, _ = M.mix_sources(docs, "doc_id", "source", "n_tokens", targets, total=20_000)
    assert sum(r["copies"] * r["n_tokens"] for r in mix.collect()) == pytest.approx(20_000, rel=0.02)


def test_missing_source_and_empty_tables(spark):
    docs, _ = table(spark)
    targets = spark.createDataFrame([("a", 0.5, 1), ("absent", 0.5, 1)], "source string, target_share double, max_repeats int")
    _, shares = M.mix_sources(docs, "doc_id", "source", "n_tokens", targets)
    assert {r["source"]: r["share"] for r in shares.collect()} == {"a": 1.0, "absent": 0.0}
    mix, shares = M.mix_sources(docs.where("false"), "doc_id", "source", "n_tokens", targets)
    assert mix.count() == 0 and {r["share"] for r in shares.collect()} == {0.0}
    assert M.mix_sources(docs, "doc_id", "source", "n_tokens", targets.where("false"))[0].count() == 0


def test_allocation():
    total, average = M.allocate({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 3)})
    assert total == 60 and average == {"a": 0.3, "b": 3.0}


def test_documents_of_a_source_are_drawn_equally_often(spark):
    docs = spark.createDataFrame([(i, "a" if i < 60 else "b", 10 + i % 3) for i in range(100)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    times, seeds = dict.fromkeys(range(100), 0), 25
    for seed in range(seeds):
        for r in M.mix_sources(docs, "doc_id", "source", "n_tokens", targets, total=440, seed=seed)[0].collect():
            times[r["doc_id"]] += 1
    for source, n in ((range(60), 60), (range(60, 100), 40)):
        odds = 220 / (11 * n)
        off = [(times[i] - seeds * odds) / (seeds * odds * (1 - odds)) ** 0.5 for i in source]
        assert max(map(abs, off)) < 4.5 and sum(x * x for x in off) / n == pytest.approx(1, abs=0.6)

import math
import random
from collections import defaultdict

from cairn.operators import eventlog, ordered
from pyspark.sql import functions as F


def rows(seed=1, n=400):
    r = random.Random(seed)
    return [(r.choice(["hot"] * 6 + ["b", "c", None]), i, r.choice([None, *range(-5, 30)])) for i in r.sample(range(10_000), n)]


def by_key(data):
    out = defaultdict(list)
    for k, o, v in sorted(data, key=lambda x: x[1]):
        out[k].append((o, v))
    return out


def test_placed_over_many_parts(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, o int, v int")
    got = {(r["k"], r["o"]): (r["seq"], r["n"]) for r in ordered.placed(df, ["k"], ["o"], parts=9).collect()}
    assert got == {(k, o): (i, len(list_)) for k, list_ in by_key(data).items() for i, (o, _) in enumerate(list_, 1)}
    assert ordered.placed(df.where("false"), ["k"], ["o"]).count() == 0


def test_running_and_previous_over_many_parts(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, o int, v int")
    got = {(r["k"], r["o"]): r for r in ordered.running(df, ["k"], ["o"], {"total": ("sum", "v"), "most": ("max", "v"), "n": ("count", "v")}, parts=9).collect()}
    before = {(r["k"], r["o"]): r["b"] for r in ordered.previous(df, ["k"], ["o"], "v", "b", parts=9).collect()}
    place = {(r["k"], r["o"]): r["seq"] for r in ordered.numbered(df, ["k"], ["o"], parts=9).collect()}
    assert len(got) == len(before) == len(data)
    for k, list_ in by_key(data).items():
        seen = []
        for i, (o, v) in enumerate(list_):
            assert before[(k, o)] == (list_[i - 1][1] if i else None)
            seen += [v] if v is not None else []
            r = got[(k, o)]
            assert (r["total"], r["most"], r["n"]) == (sum(seen) if seen else None, max(seen, default=None), len(seen))
            assert place[(k, o)] == i + 1


def test_nearest_rank(spark):
    data = rows(3)
    df = spark.createDataFrame(data, "k string, o int, v int")
    got = {r["k"]: r for r in ordered.nearest_rank(df, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p100": 1.0}, parts=5).collect()}
    for k, list_ in by_key(data).items():
        values = sorted(v for _, v in list_ if v is not None)
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p100", 1.0)):
            assert got[k][name] == values[math.ceil(p * len(values)) - 1]


def test_trailing_sums(spark):
    data = rows(4)
    df = spark.createDataFrame([(k, o, 1 if v is None else v) for k, o, v in data], "k string, o bigint, v int")
    got = {(r["k"], r["o"]): r["s"] for r in ordered.trailing_sums(df, ["k"], "o", 900, {"s": "v"}).collect()}
    for k, list_ in by_key(data).items():
        for o, _ in list_:
            assert got[(k, o)] == sum(1 if v is None else v for p, v in list_ if o - 900 <= p <= o)


def test_covered_time_and_runs(spark):
    spans = [("a", 0, 10), ("a", 5, 8), ("a", 10, 12), ("a", 20, 25), ("b", 3, 3), ("c", 5, 2), ("d", None, 4)]
    df = spark.createDataFrame(spans, "k string, s int, e int")
    assert {r["k"]: (r["covered"], r["n_stretches"]) for r in eventlog.covered(df, ["k"], "s", "e").collect()} == {"a": (17, 2), "b": (0, 1)}
    flags = spark.createDataFrame([("a", i, f) for i, f in enumerate([True, True, False, True, None, True, True, True])] + [("b", 0, False)], "k string, o int, f boolean")
    assert {r["k"]: r["longest_run"] for r in eventlog.longest_runs(flags, ["k"], ["o"], F.col("f")).collect()} == {"a": 3, "b": 0}


def test_compaction_and_votes(spark):
    log = spark.createDataFrame([("a", 1, "x", 1), ("a", 2, None, 2), ("b", 3, "y", 3), ("b", 4, "deleted", None)], "k string, seq int, status string, v int")
    out = eventlog.compact(log, "k", "seq", ["status", "v"], F.col("status") == "deleted").collect()
    assert [tuple(r) for r in out] == [("a", "x", 2)]
    votes = spark.createDataFrame([(1, "p", 0.5, 1), (1, "q", 0.9, 2), (1, "q", 0.5, 3), (2, "p", 0.5, 5), (2, "q", 0.5, 4), (3, None, 1.0, 1)], "t int, c string, w double, o int")
    got = {r["t"]: (r["winner"], r["votes"], r["agreement"], r["confidence"]) for r in eventlog.plurality(votes, "t", "c", "w", "o").collect()}
    assert got == {1: ("q", 2, 0.666667, 0.466667), 2: ("q", 1, 0.5, 0.25)}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, o int, v int")
    assert ordered.numbered(df, ["k"], ["o"]).count() == 0
    assert eventlog.covered(df, ["k"], "o", "v").count() == 0

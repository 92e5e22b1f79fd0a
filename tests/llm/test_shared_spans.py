import random
from collections import defaultdict

import numpy as np
import pytest
from cairn.llm import shared_spans as S


def brute(rows, length):
    where = defaultdict(set)
    for d, t in rows:
        if d is not None and t:
            for i in range(len(t) - length + 1):
                where[t[i : i + length]].add(d)
    out = set()
    for d, t in rows:
        if d is None or not t:
            continue
        shared = np.zeros(len(t) + 2, int)
        for i in range(len(t) - length + 1):
            if len(where[t[i : i + length]]) > 1:
                shared[i + 1 : i + length + 1] = 1
        edge = np.flatnonzero(np.diff(shared))
        out |= {(d, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)}
    return out


def corpus(seed, n, alphabet):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    passages = [word(r.randint(300, 900)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [word(r.randint(0, 500))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
            parts += [r.choice([p, p[a:b], p[a:], p[:b]]), word(r.randint(0, 300))]
        rows.append((i, "".join(parts)))
    return [*rows, (900, rows[0][1]), (901, rows[0][1]), (902, None), (903, ""), (904, "a" * 1000), (905, "a" * 330 + "b"), (906, ("ab" * 400)), (907, "ab" * 200), (None, rows[1][1]), rows[2], rows[2]]


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("alphabet", ["abcdefghij 中文", "ab"])
def test_same_spans_as_brute_force(spark, monkeypatch, hot, alphabet):
    if hot:  # keys are spread over several shards, and blocks go by shuffle
        monkeypatch.setattr(S, "SHARD_CONTEXTS", 3)
        monkeypatch.setattr(S, "BROADCAST_BLOCKS", 0)
    rows = corpus(5, 40, alphabet)
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id bigint, text string, lo int")
    found = S.shared_spans(df, "doc_id", "text")
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 320)
    share = {r["doc_id"]: r["share"] for r in S.shared_share(df, "doc_id", "text", found).collect()}
    assert share[902] is None and share[903] is None and share[900] == 1.0


def test_stretches_of_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(S, "STRETCH", 400)
    rows = corpus(9, 12, "abcdefgh")
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(S.ta, "CHUNK_CHARS", 10)
    assert {tuple(r) for r in S.shared_spans(df, "doc_id", "text").collect()} == brute(rows, 320)


def test_no_shared_text(spark):
    df = spark.createDataFrame([(1, "x" * 10), (2, None)], "doc_id bigint, text string")
    assert S.shared_spans(df, "doc_id", "text").count() == 0
    assert S.shared_spans(df.where("false"), "doc_id", "text").count() == 0


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_many_records_whatever_joins_spark_picks(spark, monkeypatch, threshold):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(3, 400, "abcdefghij"))]
    monkeypatch.setattr(S, "SHARD_CONTEXTS", 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
        assert {tuple(r) for r in S.shared_spans(df, "doc_id", "text").collect()} == brute(rows, 320)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

"""Retrieval queries on small fixtures, against plain Python."""

import math
import re

import __spark_entry__ as entry
from cairn.functions.text import STOP_WORDS

CATEGORIES = ("paper_fact", "policy_change", "live_version", "package_release", "comparison", "security_advisory", "api_default", "date_lookup")


def brute_bm25(queries, docs, top=10):
    docs = {i: t.lower() for i, t in docs if t is not None}
    size = {i: max(1, len(t.split())) for i, t in docs.items()}
    mean = max(1.0, sum(size.values()) / len(size))
    out = set()
    for case, query in queries:
        terms = set(re.findall("[a-z][a-z0-9_-]+|[㐀-鿿]{2,}", (query or "").lower())) - set(STOP_WORDS)
        raw = {}
        for term in terms:
            hits = {i: t.count(term) for i, t in docs.items() if term in t}
            idf = math.log(1 + (len(docs) - len(hits) + 0.5) / (len(hits) + 0.5))
            for i, tf in hits.items():
                raw[i] = raw.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[i] / mean))
        order = sorted(raw, key=lambda i: (-round(raw[i], 9), i))[:top]
        out |= {(case, i, n, round(raw[i] / raw[order[0]], 6)) for n, i in enumerate(order, 1)}
    return out


def test_flagship_ranks_for_every_category(spark, tmp_path):
    words = ["planner", "cache", "snapshot", "relay", "ledger", "token", "摘要模块", "harbor"]
    queries = [(f"c{n}", category, f"Which {words[n]} and {words[(n + 3) % 8]} does it use?") for n, category in enumerate(CATEGORIES)]
    queries += [("none", "paper_fact", None), ("miss", "comparison", "zzz")]
    docs = [(i, " ".join(words[(i * k + k) % 8] for k in range(1, 3 + i % 5)) + " filler" * (i % 7)) for i in range(40)] + [(40, None), (41, "")]
    spark.createDataFrame(queries, "case_id string, category string, query string").write.parquet(f"{tmp_path}/eval_prompts.parquet")
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.registry.flagship(spark, str(tmp_path)).collect()
    assert {(r["case_id"], r["doc_id"], r["place"], r["score"]) for r in got} == brute_bm25([(c, q) for c, _, q in queries], docs)
    assert {r["case_id"] for r in got} == {f"c{n}" for n in range(8)}


def test_fusion_counts_every_rank(spark, tmp_path):
    pages = [(i, "t1", "official", f"https://e.example/p{(i * 7) % 110}") for i in range(130)]
    pages += [(1000 + i, "t1", "community", f"https://e.example/p{(i * 11) % 110}") for i in range(70)]
    pages += [(2000 + i, "t2", "official", f"https://e.example/p{i}") for i in range(3)] + [(3000, None, "official", "https://e.example/x"), (3001, "t2", None, "https://e.example/x")]
    spark.createDataFrame(pages, "source_id bigint, task_id string, authority string, url string").write.parquet(f"{tmp_path}/sources.parquet")
    best, seen = {}, {}
    for source, task, authority, url in sorted(pages, key=lambda p: p[0]):
        if task and authority:
            place = seen[task, authority] = seen.get((task, authority), 0) + 1
            best.setdefault((task, url), {}).setdefault(authority, place)
    expected = set()
    for task in ("t1", "t2"):
        scored = sorted(((round(sum(1 / (60 + p) for p in ranks.values()), 9), len(ranks), -min(ranks.values()), url) for (t, url), ranks in best.items() if t == task), reverse=True)
        expected |= {(task, url, score, n, -least, i) for i, (score, n, least, url) in enumerate(scored[:48], 1)}
    assert any(max(best["t1", url].values()) > 48 and n == 2 for task, url, _, n, _, _ in expected if task == "t1")
    got = entry.queries()["rank_fusion"](spark, str(tmp_path)).collect()
    assert {(r["task_id"], r["identity"], r["score"], r["n_streams"], r["best_rank"], r["fused_rank"]) for r in got} == expected

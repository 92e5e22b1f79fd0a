"""Citations, facts, similar questions, experiments, merges and records on small cases."""

import hashlib
import json
import math
import random
import time

import duckdb
from cairn.functions import evidence as E
from cairn.functions import records as R
from cairn.operators import evaluation, experiments, grounding, merging
from cairn.plans import catalog, grounding_queries
from pyspark.sql import functions as F


def test_citations(spark):
    rows = [("t", "S1", "https://www.google.com/search?q=x", "see S1", None), ("t", "S2", "https://a.example/page", "see S1", None), ("t", "S3", "https://A.example/page/", "", None), ("t", "S4", "no url", None, None), ("t", "S5", None, None, "own words here"), (None, "S6", "https://b.example", "x", None)]
    cites = spark.createDataFrame(rows, "task string, ref string, url string, answer string, own string")
    evidence = grounding.longest_texts(spark.createDataFrame([("https://a.example/page/", "short"), ("https://a.example/page", "the longer text"), (None, "x"), ("https://c.example", None)], "url string, body string"), "url", "body")
    got = {r["ref_id"]: r for r in grounding.citation_checks(cites, "task", "ref", "url", "answer", F.col("own"), evidence).collect()}
    assert len(got) == 6
    assert got["S1"]["issues"] == "search_result_page,missing_evidence" and got["S1"]["referenced"]
    assert got["S2"]["evidence"] == "retrieved" and got["S2"]["repeated"] and got["S3"]["repeated"]
    assert got["S4"]["issues"] == "invalid_url,missing_evidence" and got["S5"]["evidence"] == "citation"
    assert grounding.citation_checks(cites.where("false"), "task", "ref", "url", "answer", F.col("own"), evidence).count() == 0


def test_facts(spark):
    df = spark.createDataFrame([("The  Planner", "now the planner runs"), ("a b c d e", "a b c d x"), ("a b", "a x"), (None, "x"), ("x", None)], "f string, b string")
    assert [r[0] for r in df.select(grounding.fact_present(F.col("f"), F.col("b"))).collect()] == [True, True, False, False, False]


def test_similar_questions_as_brute_force(spark):
    r = random.Random(4)
    words = [f"word{i}" for i in range(14)]
    rows = [(f"k{i}", " ".join(r.sample(words, r.randint(3, 9)))) for i in range(60)] + [("k1", None), (None, "word1 word2"), ("z1", "Word1 word2?"), ("z2", " word1  WORD2 "), ("z2", " word1  WORD2 ")]
    form = lambda t: " ".join((t or "").lower().split()).strip("?")
    seen = {(k, form(t)) for k, t in rows if k and form(t)}
    best = {}
    for k, a in seen:
        for k2, b in seen:
            x, y = set(a.split()), set(b.split())
            score = 1.0 if a == b else len(x & y) / len(x | y) if min(len(x), len(y)) >= 5 and len(x & y) / min(len(x), len(y)) >= 0.8 else 0
            if k != k2 and score >= 0.6:
                best[k] = min(best.get(k, (0, "")), (-round(score, 6), k2))
    df = spark.createDataFrame(rows, "id string, q string")
    got = {(x["id"], x["best_key"], x["score"]) for x in grounding.best_similar(df, df, "id", "q").collect()}
    assert got == {(k, k2, -s) for k, (s, k2) in best.items()} and len(got) > 10


def test_similar_questions_of_few_sentence_forms(spark):
    # sentences of a few forms meet on many words; before, every two with one of many rare words in common were compared
    r = random.Random(7)
    words = [f"word{i}" for i in range(60)]
    frames = [[f"frame{f}x{i}" for i in range(n)] for f, n in enumerate((0, 6, 9, 15))]
    make = lambda: " ".join(r.choice(frames) + r.sample(words[: r.choice((12, 20, 60))], r.randint(4, 11)))
    asked, known = ([(f"{side}{i}", make()) for i in range(700)] for side in "qh")
    known += [(k, q + " word0") for k, q in asked[:40]] + [(f"h{i}x", q) for i, (_, q) in enumerate(asked[:20])]
    for i, n in enumerate((45, 60, 120, 300, 300)):
        long = [f"long{i}x{j}" for j in range(n)]
        asked.append((f"l{i}", " ".join(long)))
        known += [(f"m{i}x{share}", " ".join(r.sample(long, int(n * share)) + [f"more{share}x{j}" for j in range(int(n * extra))])) for share, extra in ((1, 0.1), (0.95, 0), (0.85, 0.15), (0.62, 0), (0.58, 0), (0.8, 0.19), (1, 0.66), (1, 0.68))]
    best, near = {}, set()
    for k, a in asked:
        for k2, b in known:
            x, y = set(a.split()), set(b.split())
            score = 1.0 if a == b else len(x & y) / len(x | y) if min(len(x), len(y)) >= 5 and len(x & y) / min(len(x), len(y)) >= 0.8 else 0
            if k != k2 and score >= 0.6:
                best[k] = min(best.get(k, (0, "")), (-round(score, 6), k2))
                near |= {frozenset((a, b))} if a != b else set()
    old, new = (spark.createDataFrame(rows, "id string, q string") for rows in (known, asked))
    got = {(x["id"], x["best_key"], x["score"]) for x in grounding.best_similar(new, old, "id", "q").collect()}
    assert got == {(k, k2, -s) for k, (s, k2) in best.items()} and len(got) > 50
    ids = {text: i for i, text in enumerate(sorted({q for _, q in asked + known}))}
    rows = [(i, q in {x for _, x in asked}, q in {x for _, x in known}, sorted(set(q.split()))) for q, i in ids.items()]
    sets = grounding._signed(spark.createDataFrame(rows, "id long, asked boolean, known boolean, t array<string>"))
    pairs = [frozenset(x) for x in grounding._near_sets(sets, 0.6, 0.8).collect()]
    assert {frozenset(ids[q] for q in pair) for pair in near} <= set(pairs) and len(pairs) == len(set(pairs)) < 4 * len(near)


def test_aligned_lines(spark):
    answers = spark.createDataFrame([("t", "planner keeps tokens\n\n::\ngardens bloom"), ("u", None), ("v", "planner")], "g string, a string")
    bodies = spark.createDataFrame([("t", "the planner keeps many tokens"), ("t", None)], "g string, b string")
    got = {(r["group_id"], r["line_no"]): (r["best"], r["aligned"]) for r in grounding.aligned_lines(answers, "g", "a", bodies, "b").collect()}
    assert got == {("t", 1): (1.0, True), ("t", 4): (0.0, False), ("v", 1): (0.0, False)}


def test_order_views_and_batches(spark):
    df = spark.createDataFrame([(list("ABCDE"),), (["A"],), ([],), (["A", "A", "B"],), ([f"i{n:02d}" for n in range(20)],)], "x array<string>")
    views = [r[0] for r in df.select(experiments.order_views(F.col("x"))).collect()]
    assert len(views[0]) == 10 and all(sum(v[p] == c for v in views[0]) == 2 for p in range(5) for c in "ABCDE")
    assert sum(v.index("A") < v.index("B") for v in views[0]) == 5
    assert views[1] == [["A"]] and views[2] == [[]] and sorted(views[3]) == [["A", "B"], ["B", "A"]]
    batches = [r[0] for r in df.select(experiments.overlapping_batches(F.col("x"))).collect()]
    assert len(batches[4]) == 8 and len({tuple(b) for b in batches[4]}) == 8 and all(sum(i in b for b in batches[4]) == 2 for i in batches[4][0])
    assert batches[2] == []


def test_batches_of_long_lists_as_brute_force(spark):
    # values that every item, stride and batch computed again made this take the fourth power of a list's length
    sizes = [1, 2, 3, 4, 6, 7, 15, 30, 97, 105, 200, 210, 400]
    df = spark.createDataFrame([(n, [f"i{i:03d}" for i in range(n)]) for n in sizes], "n int, x array<string>")
    began = time.monotonic()
    got = {r[0]: r[1] for r in df.select("n", experiments.overlapping_batches(F.col("x"), 5, 4)).collect()}
    assert time.monotonic() - began < 60
    for n in sizes:
        want, size = [], max(2, min(5, n))
        for p in range(4):
            stride = next(s for s in range(1 + 2 * p, 2 + 2 * p + n) if math.gcd(s, n) == 1) * (-1 if p % 2 else 1)
            walk = [f"i{((p * max(1, size // 2)) % n + i * stride) % n:03d}" for i in range(n)]
            want += [walk[i : i + size] for i in range(0, n, size)]
        assert got[n] == want


def test_batches_of_items_as_those_of_lists(spark):
    sizes = [1, 2, 3, 4, 6, 7, 15, 30, 105, 210, 426, 1155, 5003, 30030]
    df = spark.createDataFrame([(n, at) for n in sizes for at in range(n)], "n bigint, at bigint")
    got = {(r[0], r[1]): [tuple(b) for b in r[2]] for r in df.select("n", "at", experiments.batches_of(F.col("at"), F.col("n"), 5, 4)).collect()}
    for n in sizes:
        size = max(2, min(5, n))
        for p in range(4):
            stride = next(s for s in range(1 + 2 * p, 2 + 2 * p + n) if math.gcd(s, n) == 1) * (-1 if p % 2 else 1)
            start = (p * max(1, size // 2)) % n
            assert all(got[n, (start + i * stride) % n][p] == (p, i // size) for i in range(n))
    far = 3 * 5 * 7 * 11 * 13 * 17 * 19 * 23 * 29
    row = spark.createDataFrame([(far, far - 1)], "n bigint, at bigint").select(experiments.batches_of(F.col("at"), F.col("n"))).first()[0]
    assert [tuple(b) for b in row] == [(0, (far - 1) // 5), (1, pow(4, -1, far) * 3 % far // 5)]


def test_finalists_of_groups_of_any_size(spark, tmp_path):
    # groups of more than 200 tasks were left out
    sizes = {"one": 1, "two": 2, "200": 200, "201": 201, "426": 426, "1155": 1155}
    tasks = [(g, f"{g}-{i:05d}") for g, n in sizes.items() for i in range(n)] + [("two", ""), (None, "x"), ("two", None), ("426", "426-00000")]
    spark.createDataFrame(tasks, "task_group_id string, task_id string").write.parquet(f"{tmp_path}/training_tasks.parquet")
    df = grounding_queries.nominated_finalists(spark, str(tmp_path))
    got = {tuple(r) for r in df.collect()}
    want = set()
    for g, n in sizes.items():
        items = sorted({t for k, t in tasks if k == g and t is not None})
        n = len(items)
        size, calls, seen = max(2, min(5, n)), {}, {}
        for p in range(2 if n > 1 else 0):
            stride = next(s for s in range(1 + 2 * p, 2 + 2 * p + n) if math.gcd(s, n) == 1) * (-1 if p else 1)
            for i in range(n):
                item = items[((p * max(1, size // 2)) % n + i * stride) % n]
                h = hashlib.md5(f"{item}/{p * 1000 + i // size}".encode()).hexdigest()
                seen[item] = seen.get(item, 0) + 1
                calls.setdefault(item, []).extend([ord(h[1])] if ord(h[0]) % 3 == 0 else [])
        mean = {i: round(sum(c) / len(c), 6) if c else None for i, c in calls.items()}
        best = sorted(calls, key=lambda i: (-len(calls[i]), -(mean[i] or 0), i))[:3]
        want |= {(g, i, seen[i], len(calls[i]), mean[i], place) for place, i in enumerate(best, 1)}
    assert got == want and {g for g, *_ in got} == set(sizes) - {"one"}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW training_tasks AS SELECT * FROM '{tmp_path}/training_tasks.parquet/*.parquet'")
    result = con.execute(catalog.SQL["nominated_finalists"])
    assert [d[0] for d in result.description] == df.columns and set(result.fetchall()) == want


def test_experiments(spark):
    base = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, None), ("c", 1.0, 2.0), ("d", None, None)], "k string, x double, y double")
    new = spark.createDataFrame([("a", 2.0, 0.0), ("b", 2.0, None), ("c", 1.0, 2.0), ("d", 1.0, None), ("e", 1.0, 1.0)], "k string, x double, y double")
    assert {(r["k"], r["outcome"]) for r in experiments.case_changes(base, new, "k", ["x", "y"]).collect()} == {("a", "mixed"), ("b", "better"), ("c", "same"), ("d", "unknown")}
    cases = [(3, 1.0, 1.0, 0.0), (9, 1.0, -1.0, 0.0), (9, 1.0, 0.0, 0.0), (9, 1.0, 0.0, 5.0), (9, -1.0, 0.0, 0.0), (9, 0.0, 0.0, 0.0), (9, None, 1.0, None)]
    df = spark.createDataFrame(cases, "n int, x double, y double, t double")
    assert [r[0] for r in df.select(experiments.decision(F.col("n"), [F.col("x"), F.col("y")], F.col("t"))).collect()] == ["continue", "partial", "adopt", "partial", "roll_back", "continue", "continue"]
    reviews = spark.createDataFrame([("q", "A", 3), ("q", "B", 2), ("r", "A", 1), ("s", "A", 1), ("s", "B", 1), ("t", "A", 1), ("t", "A", 1)], "q string, l string, s int")
    assert {tuple(r) for r in experiments.blind_pairs(reviews, "q", "l", ["s"]).collect()} == {("q", 3, 2, "A"), ("s", 1, 1, "tie")}
    packet, keys = evaluation.blind_packet(spark.createDataFrame([("q", "x")], "k string, a string"), spark.createDataFrame([("q", "y")], "k string, a string"), "k", "a", 7)
    p, k = packet.first(), keys.first()
    assert {p["a_answer"], p["b_answer"]} == {"x", "y"} and (p["a_answer"] == "x") == (k["a_variant"] == "baseline")


def test_packing_as_brute_force(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, -1, 0, 3, 40, 99, 100, 101, r.randint(1, 60)])) for i in range(200)]
    want, left = set(), {}
    for g, i, n in rows:
        if n is not None and 0 <= n <= left.setdefault(g, 100):
            left[g] -= n
            want.add(i)
    df = spark.createDataFrame(rows, "g string, i int, n int")
    assert {x["i"] for x in merging.packed(df, ["g"], ["i"], "n", 100).collect()} == want
    assert merging.packed(df.where("false"), ["g"], ["i"], "n", 100).count() == 0


def test_reserved_place_and_first_values(spark):
    df = spark.createDataFrame([("k", i, 10 - i, i == 7) for i in range(9)] + [("m", 1, 5, False)], "k string, i int, score int, special boolean")
    got = {(r["k"], r["i"], r["place"]) for r in merging.reserved_topk(df, ["k"], [F.desc("score"), F.asc("i")], F.col("special"), [F.desc("i")], 3).collect()}
    assert got == {("k", 0, 1), ("k", 1, 2), ("k", 7, 0), ("m", 1, 1)}
    values = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "b", 3), ("k", None, 0), ("k", "c", 4)], "k string, v string, o int")
    assert merging.first_distinct(values, ["k"], "v", ["o"], 2, "l").collect()[0]["l"] == ["b", "a"]


def test_sections_and_records(spark):
    text = "intro\n# One\nbody\n| a | b |\n|---|---|\n| 1 | 2 |\n## Two\n`-j`\n`--jobs` n\nx\n`-k` y"
    df = spark.createDataFrame([(text,), (None,), ("",), ("plain",)], "t string")
    got = [r[0] for r in df.select(E.sections(F.col("t"))).collect()]
    assert [(s["kind"], s["text"].split("\n")[0]) for s in got[0]] == [("preamble", "intro"), ("heading_section", "# One"), ("heading_section", "## Two")]
    assert all(text[s["char_start"] :].startswith(s["text"]) for s in got[0])
    assert got[1] == got[2] == [] and got[3][0]["kind"] == "semantic_window"
    lines = [r[0] for r in df.select(E.record_lines(F.col("t"))).collect()]
    assert [(x["line_no"], x["kind"]) for x in lines[0]] == [(6, "table_record"), (8, "option_record"), (11, "option_record")] and lines[1] == []


def test_texts_and_urls(spark):
    df = spark.createDataFrame([("<https://E.org/a?utm_source=x>",), ("see https://e.org/a.",), ("https://e.org/a and https://e.org/b",), (None,)], "t string")
    assert [r[0] for r in df.select(E.direct_url(F.col("t"))).collect()] == ["https://E.org/a", "", "", ""]
    assert [r[0] for r in df.select(E.single_url(F.col("t"))).collect()] == ["https://E.org/a?utm_source=x".split("?")[0], "https://e.org/a", "", ""]
    ids = spark.createDataFrame([("arXiv:2401.12345v2, CVE-2026-12345 and https://pypi.org/project/Cairn/",), (None,)], "t string").select(E.object_ids(F.col("t"))).collect()
    assert sorted(ids[0][0]) == ["arxiv:2401.12345", "cve:cve-2026-12345", "pypi:cairn"] and ids[1][0] == []
    assert spark.createDataFrame([("一。二！三",), ("a，b",), (None,)], "t string").select(E.text_units(F.col("t"))).collect()[0][0] == ["一。", "二！", "三"]
    flags = spark.createDataFrame([("I am unable to say. http://a http://a http://a",), (None,)], "t string").select(E.answer_flags(F.col("t")).alias("f")).collect()
    assert flags[0]["f"]["refusal"] and flags[0]["f"]["repeated_url"] and not any(flags[1]["f"])
    cut = spark.createDataFrame([("One two. Three four five six",), ("abcdefghijklmnop",), (None,)], "t string").select(R.truncated(F.col("t"), 12)).collect()
    assert [r[0] for r in cut] == ["One two.", "abcdefghijkl", ""]


def test_result_pages():
    duck = '<a class="result__a" href="//duck.example/l/?uddg=https%3A%2F%2Fe.org%2Fa&amp;x=1">One <b>two</b></a><a class="result__snippet">three</a><a class="result__a" href="">none</a>'
    assert R.search_results(duck) == [{"title": "One two", "url": "https://e.org/a", "snippet": "three"}]
    assert R.search_results("<h2><a href='https://e.org'>T</a></h2><p>s</p>") == [{"title": "T", "url": "https://e.org", "snippet": "s"}]
    assert R.search_results(None) == R.search_results("<p>no results</p>") == []


def test_connector_answers(spark):
    works = {"results": [{"id": "https://o/1", "doi": None, "title": " T ", "publication_date": "2024-01-02", "cited_by_count": 3, "authorships": [{"author": {"display_name": "A"}}, {"author": None}]}, {"title": None}]}
    df = spark.createDataFrame([(json.dumps(works),), ("no json",), (None,)], "p string")
    got = [r[0] for r in df.select(R.openalex_rows(F.col("p"))).collect()]
    assert (got[0][0]["title"], got[0][0]["url"], got[0][0]["authors"], got[0][0]["citations"]) == ("T", "https://o/1", ["A"], 3)
    assert got[0][1]["title"] == "" and got[1] == got[2] == []
    errors = spark.createDataFrame([("Request timed out",), ("HTTP 403",), ("bad JSON",), (None,)], "m string").select(R.error_class(F.col("m"))).collect()
    assert [r[0] for r in errors] == ["timeout", "auth", "parse", "unknown"]

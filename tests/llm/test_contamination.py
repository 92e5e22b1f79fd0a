import random
import re
import unicodedata

from cairn.llm import contamination as C

TOKEN = re.compile(r"[㐀-鿿]|[^\W㐀-鿿]+")


def plain_tokens(text):
    return TOKEN.findall(unicodedata.normalize("NFKC", re.sub(f"[{C.INVISIBLE}]", "", text or "")).casefold())


def grams(t, n):
    return {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}


def brute(docs, cases):
    out = set()
    for d, text in docs:
        t = plain_tokens(text)
        five, long = grams(t, 5), grams(t, 13)
        for c, q in cases:
            w = plain_tokens(q)
            x = grams(w, 5)
            if d is not None and c is not None and ((x and 2 * len(x & five) >= len(x)) or grams(w, 13) & long):
                out.add((d, c))
    return out


def test_same_pairs_as_brute_force(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(30)] + list("中文字符") + ["ＦＵＬＬ", "Straße", "a_b"]
    cases = [(f"c{i}", " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25)))) for i in range(30)]
    cases += [("null", None), ("blank", "  "), ("again", cases[3][1]), ("again", cases[3][1]), (None, cases[4][1])]
    docs = []
    for i in range(80):
        body = [rnd.choice(words) for _ in range(rnd.randint(0, 60))]
        if rnd.random() < 0.6:
            q = (rnd.choice(cases)[1] or "").split(" ")
            a, b = sorted((rnd.randint(0, len(q)), rnd.randint(0, len(q))))
            body[10:10] = q[a:b]
        docs.append((f"d{i}", rnd.choice(["​", "", ""]).join([", ".join(body), ""])))
    docs += [("null", None), ("empty", ""), docs[0], (None, cases[0][1])]
    corpus = spark.createDataFrame([(a, b, "x") for a, b in docs], "record_id string, text string, case_id string")
    items = spark.createDataFrame([(a, b, "y") for a, b in cases], "case_id string, query string, record_id string")
    found = C.find_leaks(corpus, "record_id", "text", items)
    rows = found.collect()
    assert {(r["record_id"], r["case_id"]) for r in rows} == brute(docs, cases)
    assert len(rows) == len({(r["record_id"], r["case_id"]) for r in rows})
    text = dict(docs)
    for r in rows:
        body = C.normalised(text[r["record_id"]])[r["char_start"] : r["char_end"]]
        assert len(plain_tokens(body)) == r["longest_tokens"] >= 5
    kept = {r["record_id"] for r in C.without_leaks(corpus, "record_id", found).collect()}
    assert kept == {d for d, _ in docs} - {r["record_id"] for r in rows}


def test_empty_tables(spark):
    corpus = spark.createDataFrame([("d", "some words are here")], "record_id string, text string")
    items = spark.createDataFrame([("c", "some words are here now")], "case_id string, query string")
    assert C.find_leaks(corpus.where("false"), "record_id", "text", items).count() == 0
    assert C.find_leaks(corpus, "record_id", "text", items.where("false")).count() == 0


def test_more_test_items_than_one_group(spark, monkeypatch):
    cases = [(f"c{i}", " ".join(f"w{i}x{j}" for j in range(15))) for i in range(12)]
    docs = [(f"d{i}", "before " + cases[i][1] + " and " + cases[(i + 5) % 12][1]) for i in range(12)]
    monkeypatch.setattr(C, "GROUP_CHARS", 200)
    corpus, items = spark.createDataFrame(docs, "record_id string, text string"), spark.createDataFrame(cases, "case_id string, query string")
    rows = C.find_leaks(corpus, "record_id", "text", items).collect()
    assert {(r["record_id"], r["case_id"]) for r in rows} == brute(docs, cases) and len(rows) == 24

from urllib.parse import parse_qs, urldefrag, urlencode, urlparse

from cairn.functions import html, jsontext, passages, similarity, text, urls
from cairn.operators import passages as rows
from cairn.operators import ranking, selection
from pyspark.sql import functions as F

URLS = [
    "HTTPS://Www.Example.com/a/b/?utm_source=x&b=2&a=1&b=3#frag", "http://example.com", "http://example.com/", "https://x.gov.uk/p?q=a b%20c&&empty", "ftp://x.y/z", "not a url", "", None,
    "https://user@docs.github.com:8080/file.pdf?fbclid=1", "https://a.b.co.uk/2024/03/05/post/", "https://e.com/path//?q=~*",
]


def one(spark, values, **columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [r.asDict() for r in df.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()]


def test_url_identities(spark):
    u = F.col("u")
    got = one(spark, URLS, n=urls.normalise_url(u), d=urls.url_identity(u), h=urls.host(u), o=urls.owner_label(u), p=urls.path_date(u), pdf=urls.is_pdf(u), c=urls.canonical_url(u))
    for value, r in zip(URLS, got, strict=True):
        p = urlparse(urldefrag((value or "").strip())[0])
        if p.scheme in ("http", "https") and p.netloc:
            q = [(k, v) for k, vs in parse_qs(p.query, keep_blank_values=True).items() if not k.lower().startswith(urls.TRACKING) for v in vs]
            assert r["n"] == p._replace(query=urlencode(q), path=p.path or "/").geturl()
        else:
            assert r["n"] == r["d"] == ""
        assert r["h"] == (urlparse((value or "").strip()).hostname or "").removeprefix("www.")
    assert got[0]["d"] == "https://www.example.com/a/b?b=2&b=3&a=1"
    assert got[0]["c"] == "https://www.example.com/a/b/?b=2&a=1&b=3" and got[5]["c"] == "not a url"
    assert [r["o"] for r in got][:2] == ["example", "example"] and got[9]["o"] == "b" and got[8]["o"] == "github"
    assert got[9]["p"] == "2024-03-05" and got[8]["pdf"]


def test_text_forms_and_dates(spark):
    t = F.col("u")
    got = one(spark, ["  Hello\n World?! ", None, "截至 2024-02-30 and 1 May 2025", "2025年3月5日", "中文 mixed"], k=text.query_key(t), d=text.explicit_date(t), f=text.script_family(t), q=text.query_terms(t))
    assert [r["k"] for r in got][:2] == ["hello world", ""]
    assert [r["d"] for r in got] == ["", "", "", "2025-03-05", ""]
    assert [r["f"] for r in got] == ["latin", "none", "latin", "cjk", "mixed"]
    assert got[2]["q"] == ["may"] and got[1]["q"] == []


def test_similarity(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"]), ([], ["a"]), (None, ["a"])], "a array<string>, b array<string>")
    got = df.select(similarity.jaccard(F.col("a"), F.col("b")).alias("j"), similarity.token_f1(F.col("a"), F.col("b")).alias("f"), similarity.ngrams(F.col("a"), 2).alias("g")).collect()
    assert [r["j"] for r in got][:2] == [0.5, 0.0] and abs(got[0]["f"] - 2 / 3) < 1e-9 and got[1]["f"] is None
    assert got[0]["g"] == ["a b", "b c"] and got[1]["g"] == []


def test_sentences_and_chunks():
    assert passages.sentences("Dr. Who paid 3.50 to e.g. A. Smith. Then he left! Why? 好的。再见") == ["Dr. Who paid 3.50 to e.g. A. Smith.", "Then he left!", "Why?", "好的。", "再见"]
    assert passages.sentences(None) == []
    body = "\n".join(f"Sentence {i} of the text is here. And one more follows it." for i in range(30)) + "\n" + "word " * 100
    out = passages.chunks(body, 40, 0.2)
    assert all(passages.word_count(c) <= 40 for c in out) and "".join(out).count("Sentence 29") >= 1
    assert out[1].startswith("And one more follows it.")
    assert passages.chunks("") == passages.chunks(None) == []
    assert passages.line_chunks("a\nbb\r\nccc\n", 5, 1) == [(1, 2, "a\nbb\n"), (2, 3, "bb\nccc\n")]


def test_literals_and_quotes():
    got = [(k, v) for k, v, *_ in passages.literals("CVE-2024-12345 of 2024-05-06 in v1.02.3, 2023 and 123456; 5 March 2021; M 7.5%")]
    assert got == [("cve", "CVE-2024-12345"), ("date", "2024-05-06"), ("version", "1.2.3"), ("year", "2023"), ("numeric_id", "123456"), ("date", "2021-03-05")]
    source = "The  Planner\nmeasures — every Straße."
    assert passages.locate_quote(source, "measures") == (13, 21, "exact")
    assert passages.locate_quote(source, "MEASURES") == (13, 21, "casefold")
    assert passages.locate_quote(source, "the planner measures") == (0, 21, "spacing")
    assert passages.locate_quote(source, "planner measures every") == (5, 29, "compact")
    assert passages.locate_quote(source, "STRASSE")[:2] == (30, 36)
    assert passages.locate_quote(source, "absent") is None and passages.locate_quote(None, "x") is None


def test_html():
    page = html.read_page(
        """<html><head><title>A &amp; B</title><meta name="date" content="2024-01-02"></head><body><nav><a href="/x">Menu</a></nav><div class="cookie-banner">Cookies</div>
        <main><h1>Head</h1><p>Some <b>bold</b> text with a <a href="/link#f">link</a>.</p><ul><li>one</li><li>two</li></ul><pre>code  here
 line</pre><table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table><p>Unclosed<p>Next</main><footer>Foot</footer></body></html>""",
        "https://e.com/",
    )
    assert page["title"] == "A & B" and page["published"] == "2024-01-02"
    assert page["markdown"] == "# Head\n\nSome bold text with a [link](https://e.com/link#f).\n\n- one\n\n- two\n\n```\ncode  here\n line\n```\n\n| a | b |\n| --- | --- |\n| 1 |  |\n\nUnclosed\n\nNext"
    assert page["links"] == [("https://e.com/x", "Menu"), ("https://e.com/link", "link")]
    assert html.read_page(None)["markdown"] == "" and html.markdown_table([]) == ""
    clean = html.clean_lines("Home\nSkip to content\nA fact.\nA  fact.\n![x](y)\n```\nHome\n```\n[t](javascript:x) and [u](https://e.com)")
    assert clean["text"] == "A fact.\n```\nHome\n```\nt and [u](https://e.com)" and clean["navigation_lines"] == 2 and clean["picture_lines"] == 1


def test_passage_rows_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "One. Two.", "x", 7), (2, None, None, 8)], "id int, body string, sentence string, place int")
    out = rows.sentence_rows(df, "body").orderBy("id", "place").collect()
    assert [(r["id"], r["place"], r["sentence"]) for r in out] == [(1, 0, "One."), (1, 1, "Two.")]
    assert rows.quote_rows(df.withColumn("q", F.lit("Two")), "body", "q").where("basis = 'exact'").first()["start_char"] == 5


def test_encodings():
    assert passages.decoded("中文内容".encode("gb18030")) == "中文内容"
    assert passages.decoded("Zürich".encode()) == "Zürich" and passages.decoded(None) is None and passages.decoded(b"") == ""
    assert passages.mojibake_repaired("Zürich".encode().decode("latin-1")) == "Zürich"


def test_greedy_quota(spark, monkeypatch):
    monkeypatch.setattr(selection, "ROUND", 7)
    data = [(i, f"d{i % 2}", f"f{i % 3}" if i % 5 else None) for i in range(60)]
    quotas, limit, used, want = {"d": 8, "f": 5}, 12, {}, []
    for row in data:
        keys = [("d", row[1]), ("f", row[2])]
        if len(want) < limit and all(used.get(k, 0) < quotas[k[0]] for k in keys):
            want.append(row[0])
            for k in keys:
                used[k] = used.get(k, 0) + 1
    df = spark.createDataFrame(data, "i int, d string, f string")
    assert sorted(r["i"] for r in selection.greedy_quota(df, ["i"], quotas, limit).collect()) == want
    assert selection.greedy_quota(df.where("false"), ["i"], quotas, limit).count() == 0


def test_term_counts_without_overlaps(spark):
    docs = spark.createDataFrame([(1, "AAAA token Tokens"), (2, None), (3, "")], "id int, body string")
    terms = spark.createDataFrame([("aa",), ("token",), ("tokens",), ("",)], "term string")
    got = {(r["id"], r["term"]): r["tf"] for r in ranking.term_counts(docs, "id", "body", terms).collect()}
    assert got == {(1, "aa"): 2, (1, "token"): 2, (1, "tokens"): 1, (3, None): 0}


def test_retrieval_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "x", 1)], "q string, i string, rank int")
    relevant = spark.createDataFrame([("q", "b"), ("q", "z"), ("s", "k")], "q string, i string")
    got = {r["q"]: tuple(r)[1:] for r in ranking.retrieval_metrics(ranked, relevant, "q", "i", "rank", 2).collect()}
    assert got["q"] == (0.5, 0.5, 0.5, 0.3869) and got["r"] == (None, 0.0, None, None) and got["s"] == (0.0, 0.0, 0.0, 0.0)


def test_sitemaps_and_json():
    xml = "<loc>https://e.com/a</loc><loc>\nhttps://e.com/de.xml </loc><loc>https://e.com/en/map.xml</loc><loc>https://e.com/a</loc><loc>https://e.com/x.xml.gz</loc>"
    assert html.sitemap_urls(xml) == (["https://e.com/a"], ["https://e.com/en/map.xml", "https://e.com/de.xml"]) and html.sitemap_urls(None) == ([], [])
    assert jsontext.object_of('<think>x</think>```json\n[{"b": 1, "a": {"c": true, "d": null, "e": "t"}}]\n```') == {"b": 1, "a": {"c": True, "d": None, "e": "t"}}
    for bad in (None, "", "Here: {}", "[1]", "[{}, {}]", "{"):
        assert jsontext.object_of(bad) is None
    assert jsontext.canonical({"b": 1, "a": [2]}) == '{"a":[2],"b":1}' and len(jsontext.digest({"a": 1})) == 20
    assert jsontext.flattened({"a": {"c": True, "d": None}, "b": 2}) == {"a.c": 1.0, "b": 2.0}

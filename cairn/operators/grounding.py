"""Checks of answers and citations against the texts they rest on."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import similarity, terms, text, urls
from cairn.session import checkpointed

#: Hosts whose pages are lists of search results.
RESULT_HOSTS = ("google.com", "bing.com", "duckduckgo.com", "search.brave.com", "search.yahoo.com", "baidu.com")
#: Origins of texts that are no evidence.
NO_EVIDENCE = ("discovery", "search_result", "snippet")

#: Fixed value: 64-bit words of a set's signature.
_LONGS = 4

_TOKENS = r"[A-Za-z][A-Za-z0-9_-]{2,}|[㐀-鿿]{2,}"


def tokens(c: Column) -> Column:
    """Distinct words of three characters or more and runs of two or more ideographs, lower-case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_TOKENS), 0), F.lower))


def is_result_page(url: Column) -> Column:
    """Whether a URL is a page of search results: of such a host, or of one below it if its path is empty or speaks of search."""
    name, path = urls.host(url), F.lower(F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1))
    below = name.rlike(r"\.(" + "|".join(h.replace(".", r"\.") for h in RESULT_HOSTS) + ")$")
    return name.isin(*RESULT_HOSTS) | (below & (path.isin("", "/") | F.contains(path, F.lit("search"))))


def longest_texts(evidence: DataFrame, url: str, body: str) -> DataFrame:
    """(plain_url, body): the longest text of each URL; of equally long ones the greatest. Null and blank ones are left out."""
    rows = evidence.select(urls.plain_url(F.col(url)).alias("plain_url"), F.trim(body).alias("body")).where("plain_url <> '' AND body <> ''")
    return rows.groupBy("plain_url").agg(F.max(F.struct(F.length("body").alias("n"), "body")).alias("b")).select("plain_url", "b.body")


def citation_checks(citations: DataFrame, group: str, ref_id: str, url: str, answer: str, inline: Column, evidence: DataFrame) -> DataFrame:
    """A row for each citation: whether its URL is valid, a page of results, repeated in its group, and named in the answer; its evidence and support; its issues.

    ``inline`` is the citation's own text, '' or null where it has none; else the longest text that ``evidence``
    (plain_url, body) has for its URL counts. Support is the share of the answer's tokens in the text, of at
    most 12, rounded to 4 places; null where either has none.
    """
    own = F.trim(F.coalesce(inline, F.lit("")))
    rows = citations.select(F.col(group).alias("group_id"), F.col(ref_id).alias("ref_id"), F.col(url).alias("url"), F.coalesce(F.col(answer), F.lit("")).alias("answer"), own.alias("own"), urls.plain_url(F.col(url)).alias("plain_url"))
    joined = rows.join(evidence, "plain_url", "left")
    body = F.when(F.col("own") != "", F.col("own")).otherwise(F.coalesce("body", F.lit("")))
    repeats = rows.where("plain_url <> ''").groupBy("group_id", "plain_url").agg(F.count("*").alias("n_same"))
    joined = joined.join(repeats, ["group_id", "plain_url"], "left")
    valid = F.col("url").rlike(r"(?i)^\s*https?://[^/?#\s]")
    valid = F.coalesce(valid, F.lit(False))
    seen, low = tokens(body), F.lower("answer")
    asked = tokens(F.col("answer"))
    both = F.size(F.array_intersect(seen, asked))
    support = F.when((F.size(seen) > 0) & (F.size(asked) > 0), F.round(F.least(F.lit(1.0), both / F.greatest(F.lit(1), F.least(F.size(seen), F.lit(12)))), 4))
    named = ((F.col("ref_id") != "") & F.contains(low, F.lower("ref_id"))) | ((F.coalesce("url", F.lit("")) != "") & F.contains(low, F.lower("url")))
    out = joined.select(
        "group_id", "ref_id", valid.alias("url_valid"), (valid & is_result_page(F.col("url"))).alias("result_page"), (F.coalesce("n_same", F.lit(0)) > 1).alias("repeated"), F.coalesce(named, F.lit(False)).alias("referenced"),
        F.when(F.col("own") != "", "citation").when(body != "", "retrieved").otherwise("none").alias("evidence"), support.alias("support"),
    )
    issues = F.array_compact(F.array(F.when(~F.col("url_valid"), "invalid_url"), F.when(F.col("result_page"), "search_result_page"), F.when(F.col("evidence") == "none", "missing_evidence")))
    return out.withColumn("issues", F.array_join(issues, ","))


def fact_present(fact: Column, body: Column, share: float = 0.8) -> Column:
    """Whether a body holds a fact, in normal form, or at least ``share`` of its tokens; false for empty ones."""
    expected, observed = text.spaced(fact), text.spaced(body)
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Za-z0-9_]+|[㐀-鿿]"), 0))
    want = words(expected)
    ratio = F.size(F.array_intersect(want, words(observed))) / F.size(want)
    return (expected != "") & (observed != "") & (F.contains(observed, expected) | ((F.size(want) > 0) & (ratio >= share)))


def coverage(point: Column, body: Column, stops: tuple[str, ...]) -> Column:
    """(n_required, n_matched, score, compact_score, basis): whether a body covers a point, by its terms or by its compact terms.

    'direct_terms': at least 0.6 of the point's terms, 3 or more (2 if it has at most two); 'compact_terms': half of the compact
    terms and between 3 and 10 of them; else 'none'. Terms are words and ideograph runs with their 2- to 4-grams.
    """
    def full(c: Column) -> Column:
        found = F.filter(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_TOKENS), 0), F.lower), lambda t: ~t.isin(*stops))
        every = F.flatten(F.transform(found, lambda t: F.when(t.rlike("^[㐀-鿿]"), F.concat(F.array(t), terms.grams(t, 2, 3, 4))).otherwise(F.array(t))))
        return F.filter(F.array_distinct(every), lambda t: ~t.isin(*stops))

    def share(n: Column, of: Column) -> Column:
        return n / F.greatest(of, F.lit(1))

    a, c = full(point), terms.compact_terms(point, stops)
    n_a, n_c = F.size(F.array_intersect(a, full(body))), F.size(F.array_intersect(c, terms.compact_terms(body, stops)))
    direct = (n_a >= F.when(F.size(a) <= 2, 2).otherwise(3)) & (share(n_a, F.size(a)) >= 0.6)
    most = F.greatest(F.lit(3), F.least(F.lit(10), F.floor((F.size(c) + 1) / 2)))
    compact = (n_c >= most) & (share(n_c, F.size(c)) >= 0.5)
    return F.struct(F.size(a).alias("n_required"), n_a.alias("n_matched"), F.round(share(n_a, F.size(a)), 4).alias("score"), F.round(share(n_c, F.size(c)), 4).alias("compact_score"), F.when(direct, "direct_terms").when(compact, "compact_terms").otherwise("none").alias("basis"))


def aligned_lines(answers: DataFrame, group: str, answer: str, bodies: DataFrame, body: str, least: float = 0.12) -> DataFrame:
    """(group_id, line_no, best, aligned): the share of each answer line's tokens in the best text of its group.

    Blank lines and lines without tokens are left out; a line of a group without texts has a share of 0. Lines and texts meet on
    (group, token), so the work grows with the tokens they share.
    """
    lines = answers.select(F.col(group).alias("group_id"), F.posexplode(F.split(F.coalesce(F.col(answer), F.lit("")), "\n")).alias("at", "line"))
    lines = lines.select("group_id", (F.col("at") + 1).alias("line_no"), tokens(F.col("line")).alias("tokens")).where(F.size("tokens") > 0)
    words = lines.select("group_id", "line_no", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token"))
    texts = bodies.select(F.col(group).alias("group_id"), F.xxhash64(body).alias("text_id"), F.explode(tokens(F.col(body))).alias("token")).distinct()
    shared = words.join(texts, ["group_id", "token"]).groupBy("group_id", "line_no", "n_tokens", "text_id").agg(F.count("*").alias("n"))
    best = shared.groupBy("group_id", "line_no").agg(F.max(F.col("n") / F.col("n_tokens")).alias("best"))
    out = lines.select("group_id", "line_no").join(best, ["group_id", "line_no"], "left")
    return out.select("group_id", "line_no", F.round(F.coalesce("best", F.lit(0.0)), 4).alias("best"), (F.coalesce("best", F.lit(0.0)) >= least).alias("aligned"))


def best_similar(queries: DataFrame, history: DataFrame, key: str, value: str, threshold: float = 0.6, least: int = 5, contained: float = 0.8) -> DataFrame:
    """(key, best_key, score): for each query the most similar one of ``history`` with another key, by shares of tokens in both.

    Equal normal forms score 1. Otherwise both need ``least`` tokens, the smaller set must lie in the other by ``contained``,
    and the score is the Jaccard share; pairs below ``threshold`` don't count; ties go to the least key. Forms, of which each
    counts once, meet on their rarest tokens and the smaller one's size: sets of that similarity share one of the first few in order of
    rarity. Of those that meet, only the pairs whose signatures differ by no more bits than such sets can differ by tokens are compared.
    """
    def formed(df: DataFrame) -> DataFrame:
        form = F.translate(text.query_key(F.col(value)), "零〇一二三四五六七八九", "00123456789")
        return df.select(F.col(key).alias("k"), form.alias("form")).where("form <> '' AND k IS NOT NULL").distinct()

    a = checkpointed(formed(queries))
    b = a if history is queries else checkpointed(formed(history))
    # two keys of a form stand for all, as one of them is another key
    keys = b.groupBy("form").agg(F.min("k").alias("k1"), F.max("k").alias("k2"))
    other = F.when(F.col("k1") != F.col("k"), F.col("k1")).when(F.col("k2") != F.col("k"), F.col("k2"))
    equal = a.join(keys, "form").select("k", other.alias("best_key"), F.lit(1.0).alias("score"))
    tokens_ = F.array_distinct(F.regexp_extract_all("form", F.lit("[a-z0-9_]+|[㐀-鿿]"), 0))
    forms = a.select("form").distinct().withColumn("asked", F.lit(True)).join(keys, "form", "full")
    forms = checkpointed(forms.select(F.monotonically_increasing_id().alias("id"), "form", F.col("asked").isNotNull().alias("asked"), "k1", "k2", tokens_.alias("t")))
    sets = checkpointed(_signed(forms.where(F.size("t") >= least).select("id", "asked", F.col("k1").isNotNull().alias("known"), "t")))
    both = _near_sets(sets, threshold, contained).join(sets.select("id", "t"), "id").join(sets.select(F.col("id").alias("id2"), F.col("t").alias("t2")), "id2")
    both = both.where(F.size(F.array_intersect("t", "t2")) / F.least(F.size("t"), F.size("t2")) >= contained).select("id", "id2", similarity.jaccard(F.col("t"), F.col("t2")).alias("score")).where(F.col("score") >= threshold)
    near = both.union(both.select("id2", "id", "score")).join(forms.where("asked").select("id", "form"), "id").join(forms.where("k1 IS NOT NULL").select(F.col("id").alias("id2"), "k1", "k2"), "id2")
    near = a.join(near, "form").select("k", other.alias("best_key"), "score")
    every = equal.unionByName(near).where("best_key IS NOT NULL").select("k", F.struct((-F.round("score", 6)).alias("less"), "best_key").alias("b"))
    return every.groupBy("k").agg(F.min("b").alias("b")).select(F.col("k").alias(key), "b.best_key", (-F.col("b.less")).alias("score"))


def _signed(sets: DataFrame) -> DataFrame:
    """``sets`` (id, asked, known, t) with the tokens ``t`` in order of rarity, their number ``n`` and a signature of them, s0 and so on."""
    words = sets.select("id", "asked", "known", F.explode("t").alias("w"))
    rare = words.groupBy("w").agg(F.count("*").alias("n"))
    bit = F.pmod(F.xxhash64("w"), F.lit(64 * _LONGS))
    signs = [F.bit_or(F.when(F.floor(bit / 64) == i, F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"s{i}") for i in range(_LONGS)]
    ranked = words.join(rare, "w").groupBy("id", "asked", "known").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("o"), *signs)
    return ranked.select("id", "asked", "known", F.col("o.w").alias("t"), F.size("o").alias("n"), *[f"s{i}" for i in range(_LONGS)])


def _near_sets(sets: DataFrame, threshold: float, contained: float) -> DataFrame:
    """(id, id2): each pair of sets that lie in each other by ``contained`` and have a Jaccard share of ``threshold`` once, the smaller first, and a few others.

    Such sets of sizes a <= b share at least contained * a and threshold / (1 + threshold) * (a + b) tokens. From the first of these
    on, in order of rarity, either set therefore has as many tokens left. The larger set is repeated for each size that the smaller
    one may have, from 48 on for each step of 5 %, and meets it only on as many tokens as that size asks for. Signatures differ in no more
    bits than sets in tokens.
    """
    # quotients are moved by a millionth to the side of more pairs, and words whose hashes are equal by chance add pairs too
    part, tiny = threshold / (1 + threshold), 1e-6
    up = lambda c: F.ceil(c - tiny).cast("int")
    down = lambda c: F.floor(c + tiny).cast("int")
    n, n2, left = F.col("n"), F.col("n2"), F.col("n") - F.col("at")
    signs = [f"s{i}" for i in range(_LONGS)]
    first = lambda size: sets.select("id", "n", "asked", "known", *signs, F.posexplode(F.slice("t", F.lit(1), size)).alias("at", "w"))
    step = lambda size: F.when(size <= 48, size).otherwise(48 + F.floor(F.log(size / 48) / math.log(1.05)).cast("int"))
    size = F.when(F.col("step") <= 48, F.col("step")).otherwise(48 * F.pow(F.lit(1.05), F.col("step") - 48))
    small = first(n - up(n * max(contained, 2 * part)) + 1).select(F.xxhash64("w", step(n)).alias("key"), "id", "n", left.alias("left"), "asked", "known", *signs)
    high = [down(left / contained)] * (contained > 0) + [down(left / part - n)] * (part > 0)
    large = first(n - up(n * threshold) + 1).withColumn("low", up(n * threshold)).withColumn("high", F.least(n, n, *high))
    large = large.where("low <= high").withColumn("step", F.explode(F.sequence(step(F.col("low")), step(F.col("high")))))
    need = F.greatest(up(size * contained), up((size + n) * part))
    large = large.select(F.xxhash64("w", "step").alias("key"), need.alias("need"), *[F.col(c).alias(f"{c}2") for c in ("id", "n", "asked", "known")], *[F.col(c).alias(f"{c}_2") for c in signs])
    differ = reduce(Column.__add__, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_2"))) for c in signs])
    close = (differ <= n + n2 - 2 * F.col("need")) & (F.col("left") >= F.col("need"))
    once = (n < n2) | ((n == n2) & (F.col("id") < F.col("id2")))
    asked = (F.col("asked") & F.col("known2")) | (F.col("asked2") & F.col("known"))
    return small.join(large, (small["key"] == large["key"]) & close & once & asked).select("id", "id2").distinct()

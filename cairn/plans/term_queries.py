"""Queries on the terms and anchors of test questions, and on how pages meet the goals of their tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import terms, text
from cairn.plans.catalog import query
from cairn.plans.text_queries import TERMS_SQL
from cairn.sources.tables import table


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _once(sql: str) -> str:
    """First occurrences of a list's values, in order."""
    return f"list_transform([{sql}], lambda l: list_filter(l, lambda x, i: list_position(l, x) = i))[1]"


def _grams(run: str, *sizes: int) -> str:
    return "flatten([" + ", ".join(f"list_transform(range(1, greatest(length({run}) - {n} + 2, 1)), lambda i: substr({run}, CAST(i AS INT), {n}))" for n in sizes) + "])"


_STRIPPED = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(query, ''), 'https?://\S+', ' ', 'gi'), '(?:^|\s)site:[A-Za-z0-9.-]+', ' ', 'gi'), '[\s\p{Z}]+', ' ', 'g'))"
_VERSIONS = r"list_filter(regexp_extract_all({0}, '[0-9.]+'), lambda v: regexp_full_match(v, '\d+\.\d+(\.\d+)?'))"
_NO_URL = r"regexp_replace(coalesce(query, ''), 'https?://\S+', ' ', 'gi')"
_ANCHORS = _once(r"list_concat(list_transform(regexp_extract_all(" + _NO_URL + r", '(?i)\b(?:CVE-\d{4}-\d{4,}|CWE-\d+|GHSA-[A-Za-z0-9-]+|RFC\s*\d+|PEP\s*\d+)\b'), lambda x: lower(regexp_replace(x, '\s+', '', 'g'))), " + _VERSIONS.format(_NO_URL) + ")")
# RE2 knows ASCII word ends only, so other letters are made underscores first
_WORDED = rf"regexp_replace({_STRIPPED}, '[^\x00-\x7F\p{{P}}\p{{Z}}\p{{S}}\p{{C}}]', '_', 'g')"
_LITERALS = (
    "list_slice(list_filter("
    + _once(
        "list_transform(flatten(["
        + ", ".join(f"regexp_extract_all({_WORDED}, '{p}', 1)" for p in (r"(?:^|\W)(--[A-Za-z0-9][A-Za-z0-9_-]+)", r"\b([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+)\b", r"\b([A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+){2,})\b", r"\b([A-Za-z]*[a-z][A-Z][A-Za-z0-9]*)\b", r"\b([A-Z][A-Z0-9]{2,})\b"))
        + "]), lambda x: lower(x))"
    )
    + f", lambda x: NOT list_contains({_list(terms.TOPIC_STOPS)}, x)), 1, 16)"
)
_HAN = reduce(lambda t, p: f"replace({t}, '{p}', ' ')", terms.TOPIC_PHRASES, _STRIPPED)
_TOPIC = (
    "list_slice(list_filter("
    + _once(
        rf"list_concat(list_transform(regexp_extract_all({_STRIPPED}, '[A-Za-z][A-Za-z0-9]*(?:[+_.-][A-Za-z0-9]+)*'), lambda x: lower(x)), "
        rf"flatten(list_transform(regexp_extract_all({_HAN}, '[㐀-鿿]{{2,}}'), lambda r: list_concat(CASE WHEN length(r) <= 12 THEN [r] ELSE [] END, {_grams('r', 2, 3)}))))"
    )
    + f", lambda x: NOT list_contains({_list(terms.TOPIC_STOPS)}, x) AND NOT list_contains({_ANCHORS}, x)), 1, 48)"
)


@query(
    rf"""WITH q AS (SELECT DISTINCT case_id, query, {_STRIPPED} AS stripped, trim(regexp_replace(coalesce(query, ''), '[\s\p{{Z}}]+', ' ', 'g')) AS raw FROM eval_prompts),
r AS (SELECT *, regexp_extract(raw, '^(site:[A-Za-z0-9.-]+)\s', 1, 'i') AS site, regexp_replace(raw, '^site:[A-Za-z0-9.-]+\s+', '', 'i') AS rest FROM q),
c AS (SELECT *, trim(regexp_replace(rest, '{terms.LEADS[0][4:]}', '', 'i')) AS a, trim(regexp_replace(rest, '{terms.LEADS[1]}', '')) AS b FROM r)
SELECT DISTINCT case_id, stripped, trim(site || ' ' || CASE WHEN a <> rest AND length(a) >= 2 THEN a WHEN b <> rest AND length(b) >= 2 THEN b ELSE rest END) AS focus FROM c"""
)
def query_focus(spark: SparkSession, folder: str) -> DataFrame:
    """Each test question without search operators, and without its leading request to search."""
    rows = table(spark, folder, "eval_prompts").select("case_id", "query")
    return rows.select("case_id", terms.strip_operators(F.col("query")).alias("stripped"), terms.search_focus(F.col("query")).alias("focus")).distinct()


_FAMILIES = ", ".join(f"CASE WHEN regexp_matches(coalesce(query, ''), '{p}') THEN '{name}' END" for name, p in terms.ACTIONS.items())


@query(
    rf"""WITH q AS (SELECT case_id AS id, query FROM eval_prompts UNION SELECT question_id, question FROM eval_cases)
SELECT DISTINCT id, array_to_string({_ANCHORS}, '|') AS anchors, array_to_string({_LITERALS}, '|') AS literals, coalesce(array_to_string(list_filter([{_FAMILIES}], lambda x: x IS NOT NULL), '|'), '') AS actions FROM q"""
)
def query_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers, versions, literal names and actions of all questions."""
    a = table(spark, folder, "eval_prompts").select(F.col("case_id").alias("id"), "query")
    b = table(spark, folder, "eval_cases").select(F.col("question_id").alias("id"), F.col("question").alias("query"))
    q = F.col("query")
    joined = lambda c: F.array_join(c, "|")
    return a.unionByName(b).select("id", joined(terms.fact_anchors(q)).alias("anchors"), joined(terms.literal_anchors(q)).alias("literals"), joined(terms.action_families(q)).alias("actions")).distinct()


_FOUND = "list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9_-]{{2,}}|[㐀-鿿]{{2,}}'), lambda x: lower(x)), lambda x: NOT list_contains({1}, x))"
_SIGNAL_TEXT = r"regexp_replace(coalesce(query, ''), 'https?://[^\s<>\]\[()]+', ' ', 'gi')"
_SIGNAL_STOPS = _list(terms.SIGNAL_STOPS)


def _sorted(sql: str, stops: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter({sql}, lambda x: NOT list_contains({stops}, x)))), '|')"


@query(
    rf"""SELECT DISTINCT case_id, array_to_string({_TOPIC}, '|') AS topic,
{_sorted("flatten(list_transform(" + _FOUND.format("coalesce(query, '')", _SIGNAL_STOPS) + ", lambda t: CASE WHEN regexp_matches(t, '^[㐀-鿿]') THEN " + _grams("t", 2) + " ELSE [t] END))", _SIGNAL_STOPS)} AS compact,
{_sorted("list_transform(regexp_extract_all(coalesce(query, ''), '(?i)c[+][+]|c#|[a-z][a-z0-9_+-]{2,}'), lambda x: lower(x))", _SIGNAL_STOPS)} AS latin,
CASE WHEN regexp_matches(trim(coalesce(query, '')), '^https?://\S+$', 'i') THEN '' ELSE {_sorted("list_filter(list_concat(flatten(list_transform(" + _FOUND.format(_SIGNAL_TEXT, _SIGNAL_STOPS) + ", lambda t: list_concat([t], CASE WHEN regexp_matches(t, '^[㐀-鿿]') THEN " + _grams("t", 2, 3, 4) + " WHEN regexp_full_match(t, '[a-z][a-z0-9]*(?:[_-][a-z0-9]+)+') THEN regexp_split_to_array(t, '[_-]+') ELSE [] END))), list_transform(regexp_extract_all(" + _SIGNAL_TEXT + ", '(?:^|[^A-Za-z0-9_-]|[^A-Za-z0-9_]-)(--?[A-Za-z0-9][A-Za-z0-9-]*)', 1), lambda x: lower(x))), lambda x: length(x) >= 2)", _SIGNAL_STOPS)} END AS signal,
{_sorted("list_concat(list_filter(list_transform(regexp_extract_all(coalesce(query, ''), '[A-Za-z][A-Za-z0-9_-]{2,}'), lambda x: lower(x)), lambda x: NOT list_contains(" + _list(terms.QUALITY_STOPS) + ", x)), flatten(list_transform(regexp_extract_all(coalesce(query, ''), '[㐀-鿿]{2,}'), lambda r: list_concat([r], " + _grams("r", 2, 3, 4) + "))))", "['']")} AS quality
FROM eval_prompts"""
)
def query_term_families(spark: SparkSession, folder: str) -> DataFrame:
    """The terms of each test question by five rules: for relevance, coverage, across languages, for sections, for quality."""
    q = F.col("query")
    families = {"topic": terms.topic_terms(q), "compact": terms.compact_terms(q), "latin": terms.latin_terms(q), "signal": terms.signal_terms(q), "quality": terms.quality_terms(q)}
    return table(spark, folder, "eval_prompts").select("case_id", *[F.array_join(c, "|").alias(name) for name, c in families.items()]).distinct()


_PAIRS = """p AS (SELECT DISTINCT s.source_id, s.title, s.content, s.url, t.content.goal AS query FROM sources s JOIN training_tasks t USING (task_id))"""


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with the goals of their tasks."""
    tasks = table(spark, folder, "training_tasks").select("task_id", F.col("content.goal").alias("query"))
    return table(spark, folder, "sources").select("source_id", "task_id", "title", "content", "url").join(tasks, "task_id").drop("task_id").distinct()


@query(
    rf"""WITH {_PAIRS}, f AS (SELECT source_id, {_TOPIC} AS terms, {_ANCHORS} AS anchors, {_LITERALS} AS literals, url_decode(coalesce(title, '') || ' ' || coalesce(url, '')) AS named, coalesce(title, '') || ' ' || coalesce(url, '') AS raw,
 lower(url_decode(coalesce(title, '') || ' ' || coalesce(content, '') || ' ' || coalesce(url, ''))) AS folded FROM p),
g AS (SELECT *, regexp_replace(folded, '[._/]+', '-', 'g') AS dashed, list_concat({_VERSIONS.format("named")},
   list_transform(regexp_extract_all(regexp_replace(named, '([^0-9_-])', '\1\1', 'g'), '(?i)(?:^|[^0-9])v?(\d{{1,3}}[_-]\d{{1,3}}(?:[_-]\d{{1,3}})?)(?:[^0-9]|$)', 1), lambda v: translate(v, '_-', '..'))) AS shown FROM f),
h AS (SELECT *, len(list_filter(terms, lambda t: contains(folded, t) OR contains(dashed, regexp_replace(t, '[._]+', '-', 'g')))) AS hits, len(list_filter(literals, lambda a: contains(folded, a))) AS literal_hits,
   len(list_filter(anchors, lambda a: CASE WHEN regexp_full_match(a, '\d+\.\d+(\.\d+)?') THEN list_contains({_VERSIONS.format("raw")}, a) OR regexp_matches(named, '(?i)(?:^|[^0-9])v?' || replace(a, '.', '[-_.]?') || '(?:[^0-9]|$)')
     ELSE contains(lower(regexp_replace(raw, '\s+', '', 'g')), a) END)) AS anchor_hits, list_filter(anchors, lambda a: regexp_full_match(a, '\d+\.\d+(\.\d+)?')) AS expected FROM g),
k AS (SELECT *, len(expected) > 0 AND len(shown) > 0 AND NOT list_has_any(expected, shown) AS version_conflict FROM h)
SELECT DISTINCT source_id, len(terms) AS n_terms, hits AS n_hits, len(anchors) AS n_anchors, anchor_hits AS n_anchor_hits, version_conflict,
 NOT version_conflict AND hits >= CASE WHEN len(terms) = 0 OR literal_hits > 0 THEN 0 WHEN len(terms) <= 2 THEN 1 ELSE 2 END AND (NOT (len(anchors) > 0 AND len(terms) = 0) OR anchor_hits = len(anchors)) AND (len(literals) = 0 OR literal_hits > 0) AS related,
 hits + 4 * anchor_hits AS score FROM k"""
)
def page_relevance(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each page is related to its task's goal: term hits, anchors, literal names and contradicting versions."""
    r = terms.relevance(F.col("title"), F.col("content"), F.col("url"), F.col("query"))
    return _pairs(spark, folder).select("source_id", F.explode(F.array(r)).alias("r")).select("source_id", "r.*").distinct()


@query(
    rf"""WITH {_PAIRS}, s AS (SELECT source_id, title, content, url, query, list_filter(list_distinct(regexp_extract_all(lower(coalesce(query, '')), '[a-z][a-z0-9_-]{{2,}}|[㐀-鿿]{{2,}}')), lambda x: NOT list_contains({_list(terms.BODY_STOPS)}, x)) AS b FROM p),
m AS (SELECT *, list_sort(list_filter(b, lambda t: contains(lower(coalesce(content, '')), t))) AS hit, lower(coalesce(title, '') || ' ' || coalesce(content, '') || ' ' || coalesce(url, '')) AS hay, {TERMS_SQL} AS t FROM s)
SELECT DISTINCT source_id, len(b) AS n_terms, array_to_string(hit, '|') AS matched, round(len(hit) / greatest(len(b), 1), 4) AS signal,
 len(t) > 0 AND ({" OR ".join(f"contains(hay, '{n}')" for n in terms.NOISE)}) AND len(list_filter(t, lambda x: length(x) > 4 AND contains(hay, x))) = 0 AS noise FROM m"""
)
def page_signals(spark: SparkSession, folder: str) -> DataFrame:
    """The share of its task's terms that each page's body holds, and whether the page is noise for the goal."""
    rows = _pairs(spark, folder)
    signal = terms.body_signal(F.col("content"), F.col("query"))
    noise = terms.is_noise(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "content", "url")]), text.query_terms(F.col("query")))
    out = rows.select("source_id", F.explode(F.array(signal)).alias("s"), noise.alias("noise"))
    return out.select("source_id", "s.n_terms", F.array_join("s.matched", "|").alias("matched"), "s.signal", "noise").distinct()

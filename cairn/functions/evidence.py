"""Kinds and quality of evidence records, identifiers in texts and URLs, and units of text. All are JVM expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions import urls

#: Origins of fetched bodies, of structured records and of mere discovery.
BODY_ORIGINS = ("fetched_page_body", "fetched_page_chunk", "fetched_page_body_with_model_locator", "local_document")
RECORD_ORIGINS = ("structured_api_record", "structured_record", "api_record")
FOUND_ORIGINS = ("discovery", "search_result", "snippet")
#: What a refusal says, and what shows that a prompt or a menu got into an answer.
REFUSAL = r"(?i)cannot\s+(?:confirm|answer|be\s+confirmed)|does\s+not\s+contain|unable\s+to|no\s+(?:usable\s+)?evidence|not\s+enough\s+evidence|cannot\s+be\s+answered|provided\s+(?:source|evidence)"
PROTOCOL = r"(?i)(?:^|\n)\s*(?:User|Assistant|System):|<think>|BEGIN EXECUTION|\"name\"\s*:\s*\"(?:web_search|fetch_web_url)"
NAVIGATION = r"(?i)Skip to content|Log in|Sign up|Copyright|\[首页\]|\[返回\]|javascript:void"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _filled(c: Column) -> Column:
    return F.trim(_text(c)) != ""


def evidence_kind(origin: Column, bodies: list[Column], records: list[Column]) -> Column:
    """page_body, structured_record or discovery by the stated origin; without a known one, the _legacy kind of what text there is."""
    named = F.lower(F.trim(_text(origin)))
    body, record = reduce(Column.__or__, map(_filled, bodies)), reduce(Column.__or__, map(_filled, records)) if records else F.lit(False)
    return (
        F.when(named.isin(*BODY_ORIGINS), "page_body").when(named.isin(*RECORD_ORIGINS), "structured_record").when(named.isin(*FOUND_ORIGINS), "discovery")
        .when(body, "page_body_legacy").when(record, "structured_record_legacy").otherwise("discovery")
    )


def evidence_text(kind: Column, bodies: list[Column], records: list[Column]) -> Column:
    """The first non-blank text of the kind, its ends trimmed; '' for discovery."""
    first = lambda columns: F.coalesce(*[F.when(_filled(c), F.trim(F.replace(c, F.lit("\r\n"), F.lit("\n")))) for c in columns], F.lit(""))
    return F.when(kind.startswith("page_body"), first(bodies)).when(kind.startswith("structured_record"), first(records) if records else F.lit("")).otherwise("")


def source_quality(kind: Column, text: Column, url: Column, verified: Column, rank: Column) -> Column:
    """Additive signals of a source, rounded to 4 places: its kind, a verified and a long body, an institutional host, its authority's rank."""
    score = (
        F.when(kind.startswith("structured_record"), 3.0).when(kind.startswith("page_body"), 2.0).otherwise(0.0) + F.when(F.coalesce(verified, F.lit(False)), 1.0).otherwise(0.0)
        + F.when(F.length(text) >= 2000, 0.5).otherwise(0.0) + F.when(urls.host(url).rlike(r"\.(gov|edu|org)$"), 0.75).otherwise(0.0) + F.least(F.lit(1.5), F.coalesce(rank, F.lit(0)) * 0.35)
    )
    return F.round(score, 4)


def quality_score(haystack: Column, body: Column, terms: Column, rank: Column, n_dates: Column, places: int = 4) -> Column:
    """0.35 shares of terms, 0.25 length of the body (of 1200), 0.2 support, 0.1 rank and 0.1 dates (of 3), rounded; support is 1."""
    low = F.lower(_text(haystack))
    hits = F.size(F.filter(terms, lambda t: F.contains(low, t)))
    lexical = F.least(F.lit(1.0), hits / F.greatest(F.lit(1), F.least(F.size(terms), F.lit(8))))
    return F.round(0.35 * lexical + 0.25 * F.least(F.lit(1.0), F.length(_text(body)) / 1200) + 0.2 + 0.1 / F.greatest(rank, F.lit(1)) + 0.1 * F.least(F.lit(1.0), n_dates / 3), places)


def is_community_detail(url: Column) -> Column:
    """Whether a URL is one thread or question of a known community site."""
    name, path = urls.host(url), F.lower(F.regexp_extract(F.trim(_text(url)), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1))
    at = lambda domain: name.rlike(r"(^|\.)" + domain.replace(".", r"\.") + "$")
    return (at("v2ex.com") & path.rlike(r"^/t/\d+/?$")) | (at("reddit.com") & F.contains(path, F.lit("/comments/"))) | (at("stackoverflow.com") & path.rlike(r"^/questions/\d+"))


def path_rank(url: Column, documentation: Column, release: Column) -> Column:
    """0 to 3 by how well a URL's path suits a query for documentation or for a release record; 1 is neutral."""
    name, path = urls.host(url), F.lower(F.regexp_extract(F.trim(_text(url)), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1))
    return (
        F.when(documentation & (name.rlike(r"^(docs|documentation|developer)\.") | path.rlike(r"/(?:api|docs?|documentation|reference)(?:/|$)")), 3)
        .when(documentation & path.rlike(r"/(?:blog|news|announcements?|migrations?|releases?)(?:/|$)"), 0)
        .when(release & path.rlike(r"/(?:releases?|release-notes?|release_notes|changelog|downloads?)(?:/|$)"), 3)
        .when(release & path.rlike(r"/(?:advanced|tutorial|examples?|community)(?:/|$)"), 0)
        .when(path.rlike(r"/(?:current|latest|stable)(?:/|$)"), 2).when(path.rlike(r"/(?:docs?|documentation)/v?\d+(?:\.\d+){0,2}(?:/|$)"), 0).otherwise(1)
    )


def direct_url(c: Column) -> Column:
    """The normalised URL that a query consists of; '' if it is anything more."""
    bare = F.regexp_replace(F.trim(_text(c)), r"^[<>\[\]()]+|[<>\[\]()]+$", "")
    return F.when(bare.rlike(r"(?i)^https?://[^/?#\s]+\S*$"), urls.normalise_url(F.regexp_replace(bare, r"[.,;:!?]+$", ""))).otherwise("")


def single_url(c: Column) -> Column:
    """The one URL that a text names; '' for none or several."""
    found = F.filter(F.transform(F.regexp_extract_all(_text(c), F.lit(r"(?i)https?://[^\s<>\[\]()\"']+"), 0), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")), lambda u: u.rlike(r"(?i)^https?://[^/?#]"))
    return F.when(F.size(found) == 1, urls.normalise_url(F.try_element_at(found, F.lit(1)))).otherwise("")


def object_ids(c: Column) -> Column:
    """Typed identifiers that a text spells out, each once: packages by registry URL, arXiv ids, CVE ids."""
    text = _text(c)
    of = lambda name, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: F.concat(F.lit(name + ":"), F.lower(F.regexp_replace(x, r"^[/.,;:!?]+|[/.,;:!?]+$", ""))))
    return F.array_distinct(F.concat(
        of("crates", r"(?i)https?://(?:www\.)?crates\.io/crates/([^/\s?#]+)"), of("pypi", r"(?i)https?://(?:www\.)?pypi\.org/project/([^/\s?#]+)"), of("npm", r"(?i)https?://(?:www\.)?npmjs\.com/package/([^\s?#]+)"),
        of("arxiv", r"(?i)(?:^|[^0-9A-Za-z_.])(?:arXiv\s*:\s*)?(\d{4}\.\d{4,5})(?:v\d+)?(?:[^0-9A-Za-z_.]|$)"), of("cve", r"(?i)(?:^|[^0-9A-Za-z_])(CVE-\d{4}-\d{4,})"),
    ))


def answer_flags(c: Column) -> Column:
    """(refusal, protocol, navigation, repeated_url): what is wrong with an answer; a URL counts as repeated from its third time."""
    text = _text(c)
    links = F.regexp_extract_all(text, F.lit(r"https?://[^)\s]+"), 0)
    repeated = F.exists(F.array_distinct(links), lambda u: F.size(F.filter(links, lambda v: v == u)) > 2)
    return F.struct(text.rlike(REFUSAL).alias("refusal"), text.rlike(PROTOCOL).alias("protocol"), text.rlike(NAVIGATION).alias("navigation"), repeated.alias("repeated_url"))


def text_units(c: Column) -> Column:
    """A text cut after full stops, question and exclamation marks, semicolons and line feeds, or after commas where there is none of those; trimmed, without empty ones."""
    main = F.split(_text(c), r"(?<=[。！？；;\n])")
    cut = F.when(F.size(F.filter(main, lambda u: u != "")) > 1, main).otherwise(F.split(_text(c), "(?<=[，,])"))
    return F.filter(F.transform(cut, lambda u: F.regexp_replace(u, r"^\s+|\s+$", "")), lambda u: u != "")


def record_period(c: Column) -> Column:
    """(start, precision): the first ISO day of a text, else its first Chinese or English month, as the day it begins; nulls if there is neither."""
    text = _text(c)
    day = F.regexp_extract(text, r"((?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))", 1)
    zh = (F.regexp_extract(text, r"((?:19|20)\d{2})\s*年\s*(1[0-2]|0?[1-9])\s*月", i) for i in (1, 2))
    zh_year, zh_month = zh
    en = r"(?i)(?:^|[^A-Za-z])(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?\s+((?:19|20)\d{2})"
    months = {m: f"{i:02d}" for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
    en_month = F.try_element_at(F.create_map(*[F.lit(x) for p in months.items() for x in p]), F.lower(F.substring(F.regexp_extract(text, en, 1), 1, 3)))
    exact = F.try_to_date(day, "yyyy-MM-dd").isNotNull()
    start = F.when(exact, day).when(zh_year != "", F.concat_ws("-", zh_year, F.lpad(zh_month, 2, "0"), F.lit("01"))).when(en_month.isNotNull(), F.concat_ws("-", F.regexp_extract(text, en, 2), en_month, F.lit("01")))
    return F.struct(start.alias("start"), F.when(exact, "day").when((zh_year != "") | en_month.isNotNull(), "month").alias("precision"))


def primary_content(html: Column, least: int = 256) -> Column:
    """The longest <main> element of a page, else its longest <article>, of at least ``least`` characters; else the page."""
    def longest(tag: str) -> Column:
        found = F.regexp_extract_all(_text(html), F.lit(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>"), 0)
        return F.element_at(F.array_max(F.transform(found, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), F.array(x).alias("x"))))["x"], 1)

    main, article = longest("main"), longest("article")
    return F.when(F.length(main) >= least, main).when(F.length(article) >= least, article).otherwise(_text(html))


def sections(c: Column) -> Column:
    """(kind, char_start, text): a Markdown text cut at its headings; what stands before the first is the preamble. Blank sections are left out, offsets are from 0."""
    parts = F.split(_text(c), r"(?m)(?=^#{1,6}[ \t]+[^\n]+$)")
    # each part's place is the length of the parts before it
    placed = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<char_start: int, text: string>>").alias("out")), lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("char_start"), p.alias("text")))).alias("out")))["out"]
    headed = F.exists(parts, lambda p: p.rlike(r"^#{1,6}[ \t]+[^\n]"))
    kind = lambda p: F.when(p["text"].rlike(r"^#{1,6}[ \t]+[^\n]"), "heading_section").when(headed, "preamble").otherwise("semantic_window")
    return F.transform(F.filter(placed, lambda p: ~p["text"].rlike(r"^\s*$")), lambda p: F.struct(kind(p).alias("kind"), p["char_start"].alias("char_start"), p["text"].alias("text")))


def record_lines(c: Column) -> Column:
    """(line_no, kind): lines of a text that are records of their own: rows of Markdown tables without heads and rules, and first lines of option descriptions."""
    lines = F.split(_text(c), "\n")
    rule = r"^\s*\|(?:\s*:?-{2,}:?\s*\|)+\s*$"
    option = r"(?i)^\s*`--?[A-Za-z0-9]"

    def kind(x: Column, i: Column) -> Column:
        after, before = F.coalesce(F.try_element_at(lines, i + 2), F.lit("")), F.when(i > 0, F.try_element_at(lines, F.greatest(i, F.lit(1)))).otherwise("")
        row = x.rlike(r"^\s*\|.*\|.*\|") & ~x.rlike(rule) & ~after.rlike(rule)
        return F.struct((i + 1).alias("line_no"), F.when(row, "table_record").when(x.rlike(option) & ~before.rlike(option), "option_record").alias("kind"))

    return F.filter(F.transform(lines, kind), lambda r: r["kind"].isNotNull())

"""Records out of the answers of services and result pages, and small rules on records."""

from __future__ import annotations

import re
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

OPENALEX = "STRUCT<results: ARRAY<STRUCT<id: STRING, doi: STRING, title: STRING, publication_date: STRING, cited_by_count: BIGINT, primary_location: STRUCT<landing_page_url: STRING>, authorships: ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>>>>"
CROSSREF = "STRUCT<message: STRUCT<items: ARRAY<STRUCT<DOI: STRING, title: ARRAY<STRING>, URL: STRING, publisher: STRING, `container-title`: ARRAY<STRING>, author: ARRAY<STRUCT<given: STRING, family: STRING>>, published: STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>>>>>"
REPOSITORIES = "STRUCT<items: ARRAY<STRUCT<full_name: STRING, html_url: STRING, description: STRING, stargazers_count: BIGINT, updated_at: STRING>>>"

#: Parameters in which result pages wrap a target.
WRAPPED = ("uddg", "u", "url", "RU")


def _s(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _row(source: str, title: Column, url: Column, published: Column, authors: Column, doi: Column, citations: Column) -> Column:
    return F.struct(F.lit(source).alias("source"), _s(title).alias("title"), _s(url).alias("url"), _s(published).alias("published"), F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: a != "").alias("authors"), _s(doi).alias("doi"), citations.cast("bigint").alias("citations"))


def openalex_rows(payload: Column) -> Column:
    """Works of an OpenAlex answer as (source, title, url, published, authors, doi, citations); an answer that is no JSON has none."""
    works = F.coalesce(F.from_json(payload, OPENALEX)["results"], F.array())
    url = lambda w: F.coalesce(*[F.nullif(_s(c), F.lit("")) for c in (w["primary_location"]["landing_page_url"], w["doi"], w["id"])], F.lit(""))
    return F.transform(works, lambda w: _row("openalex", w["title"], url(w), w["publication_date"], F.transform(w["authorships"], lambda a: _s(a["author"]["display_name"])), w["doi"], w["cited_by_count"]))


def crossref_rows(payload: Column) -> Column:
    """Works of a Crossref answer in the same columns; the URL is that of the DOI where there is one."""
    works = F.coalesce(F.from_json(payload, CROSSREF)["message"]["items"], F.array())
    url = lambda w: F.when(_s(w["DOI"]) != "", F.concat(F.lit("https://doi.org/"), _s(w["DOI"]))).otherwise(_s(w["URL"]))
    day = lambda w: F.array_join(F.transform(F.try_element_at(w["published"]["date-parts"], F.lit(1)), lambda p: p.cast("string")), "-")
    return F.transform(works, lambda w: _row("crossref", F.try_element_at(w["title"], F.lit(1)), url(w), day(w), F.transform(w["author"], lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))), w["DOI"], F.lit(None)))


def repository_rows(payload: Column) -> Column:
    """Repositories of a code host's search answer in the same columns, stars as citations."""
    items = F.coalesce(F.from_json(payload, REPOSITORIES)["items"], F.array())
    return F.transform(items, lambda r: _row("repositories", r["full_name"], r["html_url"], F.substring(r["updated_at"], 1, 10), F.array(F.substring_index(_s(r["full_name"]), "/", 1)), F.lit(""), r["stargazers_count"]))


def unwrapped(url: str) -> str:
    """The target of a link that a result page wraps in a redirect of its own; other links as they are, with a scheme."""
    url = "https:" + url if url.startswith("//") else url
    for name, values in parse_qs(urlsplit(url).query).items():
        if name in WRAPPED and re.match(r"https?://", values[0], re.IGNORECASE):
            return values[0]
    return url


class _Results(HTMLParser):
    """Result pages of three layouts: a link of a class, a link in a heading, a card with a title."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict[str, str]] = []
        self.open: dict[str, str] | None = None
        self.into: str | None = None
        self.heading = False

    def _begin(self, href: str) -> None:
        self._end()
        self.open, self.into = {"title": "", "url": unwrapped(href), "snippet": ""}, "title"

    def _end(self) -> None:
        if self.open:
            row = {k: " ".join(v.split()) for k, v in self.open.items()}
            if row["url"] and row["title"]:
                self.rows.append(row)
        self.open, self.into = None, None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = {k: v or "" for k, v in attrs}
        classes = set(at.get("class", "").split())
        self.heading = self.heading or tag in ("h2", "h3")
        if tag == "a" and "href" in at and ("result__a" in classes or self.heading or at.get("data-matarget") == "algo"):
            self._begin(at["href"])
        elif self.open and (tag == "p" or "result__snippet" in classes):
            self.into = "snippet"

    def handle_data(self, data: str) -> None:
        if self.open and self.into:
            self.open[self.into] += " " + data

    def handle_endtag(self, tag: str) -> None:
        if tag in ("h2", "h3"):
            self.heading = False
        if self.into == "title" and tag in ("a", "h2", "h3") or self.into == "snippet" and tag in ("a", "p", "div"):
            self.into = None


def search_results(html: str | None) -> list[dict[str, str]]:
    """(title, url, snippet) of the results on a page, in order; those without title or URL are left out."""
    parser = _Results()
    parser.feed(html or "")
    parser._end()
    return parser.rows


def error_class(c: Column) -> Column:
    """What kind of error a message speaks of; the first rule that fits decides."""
    low = F.lower(F.coalesce(c, F.lit("")))
    rules = (
        ("timeout", "timeout|timed out"), ("quota", "402 |432 |usage limit|quota exceeded|quota exhausted|plan limit|insufficient credit|credits exhausted|payment required"),
        ("auth", "401|403|unauthorized|forbidden|api key|authentication"), ("rate_limit", "429|rate limit|too many"), ("parse", "json|decode|schema|parse"),
        ("network", "http|url|network|connection|dns|socket"), ("filesystem", "file|directory|permission|no such"), ("provider", "provider|model|llm"),
    )
    first = F.when(low.rlike(rules[0][1]), rules[0][0])
    return reduce(lambda w, r: w.when(low.rlike(r[1]), r[0]), rules[1:], first).otherwise("unknown")


def result_status(status: Column, n_rows: Column) -> Column:
    """'error' for a failed status, else 'ok' with rows and 'no_results' without."""
    failed = F.lower(F.trim(F.coalesce(status, F.lit("")))).isin("error", "failed", "unavailable", "unauthorized")
    return F.when(failed, "error").when(n_rows > 0, "ok").otherwise("no_results")


def clamped_budget(requested: Column, limit: Column, used: Column, margin: int = 0) -> Column:
    """What may still be asked for: ``requested`` at most, within what ``limit`` leaves, at least 1."""
    return F.greatest(F.lit(1), F.least(F.greatest(requested, F.lit(1)), F.greatest(limit, F.lit(1)) - used - F.lit(max(0, margin))))


def rule_matches(c: Column, all_: list[str], any_: list[str], none: list[str]) -> Column:
    """Whether a text holds all of some terms, one of others (if there are any) and none of a third kind."""
    low = F.lower(F.coalesce(c, F.lit("")))
    has = lambda t: F.contains(low, F.lit(t.lower()))
    every = reduce(Column.__and__, map(has, all_), F.lit(True))
    one = reduce(Column.__or__, map(has, any_)) if any_ else F.lit(True)
    return every & one & ~reduce(Column.__or__, map(has, none), F.lit(False))


def group_matches(answer: Column, groups: Column, norm) -> Column:
    """(matched, missing): how many groups of variants have one that stands in the answer, by the normal form ``norm``; groups without variants are left out."""
    body = norm(answer)
    used = F.filter(groups, lambda g: F.exists(g, lambda v: norm(v) != ""))
    hit = F.size(F.filter(used, lambda g: F.exists(g, lambda v: (norm(v) != "") & F.contains(body, norm(v)))))
    return F.struct(hit.alias("matched"), (F.size(used) - hit).alias("missing"))


def truncated(c: Column, size: int) -> Column:
    """At most ``size`` characters of a text: cut after the last stop of the second half, else before its last space, else hard."""
    text = F.coalesce(c, F.lit(""))
    head = F.substring(text, 1, size)
    stop = F.length(F.regexp_extract(head, r"(?s)^(.*[。！？；，.!?;,\n])", 1))
    space = F.length(F.regexp_extract(head, r"(?s)^(.*) ", 1))
    return F.when(F.length(text) <= size, text).when(stop > size / 2, F.substring(head, F.lit(1), stop)).when(space > size / 2, F.substring(head, F.lit(1), space)).otherwise(head)


def cutoff_date(c: Column) -> Column:
    """The ISO day that follows a word for a cutoff (as of, before, through, up to, 截至, 截止); null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?is)(?:截至|as\s+of|before|through|up\s+to|截止)\s*[:：]?\s*.*?((?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))", 1), F.lit(""))

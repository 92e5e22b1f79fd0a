"""Text columns: normal forms, tokens, dates, quote windows. All are JVM expressions; null is read as ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that don't tell a query apart.
STOP_WORDS = (
    "the", "and", "for", "from", "with", "find", "search", "look", "latest", "official", "give", "report", "according", "what", "which", "that", "this",
    "截至", "查找", "搜索", "根据", "给出", "报告", "当前", "最新", "是否",
)
#: Marks cut off the ends of a query's key.
QUERY_ENDS = " \t\r\n?？!！。.,，"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def spaced(c: Column) -> Column:
    """Lower-case, trimmed, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(_text(c)), r"[\s\p{Z}]+", " "))


def query_key(c: Column) -> Column:
    """Key by which two queries count as the same."""
    return F.regexp_replace(spaced(c), r"^[ ?？!！。.,，]+|[ ?？!！。.,，]+$", "")


def alphanumeric(c: Column) -> Column:
    """Lower-case Latin letters, digits and ideographs only."""
    return F.regexp_replace(F.lower(_text(c)), "[^a-z0-9㐀-鿿]", "")


def unified(c: Column) -> Column:
    """:func:`spaced`, with full-width colons and all dashes made plain."""
    return spaced(F.translate(_text(c), "：–—−‐‑", ":-----"))


def clipped(c: Column, size: int) -> Column:
    """White space collapsed, at most ``size`` characters."""
    return F.substring(F.trim(F.regexp_replace(_text(c), r"[\s\p{Z}]+", " ")), 1, size)


def script_family(c: Column) -> Column:
    """cjk, latin, mixed or none, by whether ideographs or Latin letters are three quarters of both."""
    han, latin = F.regexp_count(_text(c), F.lit("[㐀-鿿]")), F.regexp_count(_text(c), F.lit("[A-Za-z]"))
    total = han + latin
    return F.when(total == 0, "none").when(han * 4 >= total * 3, "cjk").when(latin * 4 >= total * 3, "latin").otherwise("mixed")


def words(c: Column) -> Column:
    """Runs of letters, digits and underscores, lower-case, in order."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(r"[\p{L}\p{N}_]+"), 0)


def query_terms(c: Column) -> Column:
    """Distinct terms that tell a query apart, sorted: Latin words and runs of ideographs of two or more, without stop words."""
    low = F.lower(_text(c))
    found = F.concat(F.regexp_extract_all(low, F.lit("[a-z][a-z0-9_-]+"), 0), F.regexp_extract_all(low, F.lit("[㐀-鿿]{2,}"), 0))
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP_WORDS])))


def explicit_date(c: Column) -> Column:
    """The first ISO date, else the first Chinese, else the first English one, as yyyy-mm-dd; '' if it is no day of the calendar or there is none."""
    text = _text(c)
    iso, zh, en = r"\b(20\d\d|19\d\d)-(\d{1,2})-(\d{1,2})\b", r"(\d{4})年(\d{1,2})月(\d{1,2})日", r"\b(\d{1,2}) (January|February|March|April|May|June|July|August|September|October|November|December) (\d{4})\b"
    months = {m: f"{i:02d}" for i, m in enumerate(("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"), 1)}
    month = F.regexp_extract(text, en, 2)
    number = F.try_element_at(F.create_map(*[F.lit(x) for p in months.items() for x in p]), month)

    def day(pattern: str) -> Column:
        y, m, d = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
        return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))

    english = F.concat_ws("-", F.regexp_extract(text, en, 3), number, F.lpad(F.regexp_extract(text, en, 1), 2, "0"))
    chosen = F.when(text.rlike(iso), day(iso)).when(text.rlike(zh), day(zh)).when(text.rlike(en), english)
    return F.coalesce(F.date_format(F.try_to_date(chosen, "yyyy-MM-dd"), "yyyy-MM-dd"), F.lit(""))


def dates_in(c: Column) -> Column:
    """All ISO days of the calendar that a text names, each once, in order."""
    found = F.array_distinct(F.regexp_extract_all(_text(c), F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), 1))
    return F.filter(found, lambda d: F.try_to_date(d, "yyyy-MM-dd").isNotNull())


def occurrences(text: Column, term: Column) -> Column:
    """How often a non-empty term stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("bigint")


def around(text: Column, term: Column, margin: int) -> Column:
    """The first occurrence of ``term`` with ``margin`` characters on either side; null if it doesn't occur."""
    at = F.instr(text, term)
    start = F.greatest(at - margin, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + F.length(term) + margin))


def versions(c: Column) -> Column:
    """Version numbers of two to four parts, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(_text(c), F.lit(r"\b\d+(?:\.\d+){1,3}\b"), 0))


def token_windows(tokens: Column, size: int) -> Column:
    """Consecutive windows of ``size`` tokens, the last one shorter."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(size)), lambda i: i < F.size(tokens))
    return F.transform(starts, lambda i: F.slice(tokens, i + 1, F.lit(size)))

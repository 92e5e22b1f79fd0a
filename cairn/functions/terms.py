"""Terms, anchors and actions of queries, and how far a text meets them. All are JVM expressions; null is read as ''."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that name no topic of a query.
TOPIC_STOPS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "could", "do", "does", "find", "for", "from", "give", "how", "in", "into", "is", "it",
    "latest", "look", "me", "of", "official", "on", "or", "page", "please", "recent", "report", "search", "show", "site", "source", "sources", "tell",
    "that", "the", "this", "to", "use", "using", "was", "were", "what", "when", "where", "which", "who", "why", "with", "would", "answer", "exact",
    "information", "request", "requested", "result", "results",
)
#: Phrases taken out of Chinese queries, in this order.
TOPIC_PHRASES = (
    "为什么", "是什么", "哪一个", "哪一天", "哪些", "如何", "怎么", "请", "查找", "搜索", "检索", "给出", "告诉", "说明", "根据", "按照", "使用",
    "官方", "页面", "来源", "结果", "回答", "信息", "当前", "最新", "核对",
)
#: Words that don't rank the sections of a page.
SIGNAL_STOPS = (
    "what", "which", "when", "where", "who", "how", "why", "is", "are", "the", "a", "an", "of", "to", "and", "or", "for", "from", "with", "tell", "give",
    "find", "list", "please", "about", "date", "dates", "information", "question", "answer", "哪些", "什么", "如何", "告诉", "请问", "是否", "有没有",
    "是什么", "什么时候", "日期", "问题", "分别",
)
#: Words that don't count for the quality of evidence.
QUALITY_STOPS = (
    "the", "and", "for", "find", "then", "from", "with", "official", "source", "search", "query", "information", "answer", "page", "please", "current",
)
#: Words that don't tell whether a body meets a query.
BODY_STOPS = (
    "what", "which", "when", "where", "who", "how", "why", "the", "official", "page", "open", "read", "summarize", "summary", "describe", "description",
    "content", "main", "key", "project", "product", "web", "website", "this",
)
#: Signs of pages about a query's words instead of its topic.
NOISE = ("dictionary", "translate", "grammar", "word meaning", "linux find", "array.prototype.find")
#: What a query begins with that only asks for a search.
LEADS = (
    r"(?i)^\s*(?:(?:please|kindly)\s+)?(?:(?:can|could|would)\s+you\s+)?(?:help\s+(?:me\s+)?(?:to\s+)?)?(?:find|search(?:\s+for)?|look\s+up|locate|retrieve)\s+(?:me\s+)?",
    r"^\s*(?:(?:请|请你|麻烦|麻烦你|劳驾)\s*)?(?:(?:帮我|帮忙)\s*)?(?:查一下|查找|搜索|检索|查询|搜一下|找出|找到)\s*[:：，,]?\s*",
)
#: Patterns of the actions that a procedure may ask for.
ACTIONS = {
    "install": r"(?i)\binstall(?:ation|ing|ed)?\b|安装|装(?:上|好)?",
    "enable": r"(?i)\benabl(?:e|ed|es|ing)\b|\bactivat(?:e|ed|es|ing)\b|\bturn\s+on\b|开启|启用|打开|(?:怎么|如何|怎样).{0,8}开",
    "disable": r"(?i)\bdisabl(?:e|ed|es|ing)\b|\bdeactivat(?:e|ed|es|ing)\b|\bturn\s+off\b|禁用|关闭",
    "create": r"(?i)\bcreat(?:e|ed|es|ing)\b|\bwrit(?:e|es|ing|ten)\b|创建|建立|编写|(?:怎么|如何|怎样).{0,8}写",
    "run": r"(?i)\brun(?:s|ning)?\b|\bexecut(?:e|ed|es|ing|ion)\b|\binvok(?:e|ed|es|ing)\b|运行|执行|调用",
    "start": r"(?i)\bstart(?:s|ed|ing)?\b|\blaunch(?:es|ed|ing)?\b|启动",
    "stop": r"(?i)\bstop(?:s|ped|ping)?\b|\bshut\s*down\b|停止",
    "check": r"(?i)\bcheck(?:s|ed|ing)?\b|\bverif(?:y|ies|ied|ying|ication)\b|\bidentify(?:ing|ied|ies)?\b|\bdetermin(?:e|ed|es|ing)\b|检查|验证|确认|识别",
    "connect": r"(?i)\bconnect(?:s|ed|ing|ion)?\b|连接",
    "calculate": r"(?i)\bcalculat(?:e|ed|es|ing|ion)\b|\bcomput(?:e|ed|es|ing|ation)\b|计算",
}
#: Actions by which each one may be met.
MET_BY = {
    "install": ("install", "build"), "enable": ("enable", "disable", "configure", "build", "install"), "disable": ("disable", "configure", "stop"), "create": ("create",),
    "run": ("run", "start"), "start": ("start", "run", "enable"), "stop": ("stop", "disable"), "check": ("check",), "connect": ("connect", "configure"), "calculate": ("calculate",),
}

_NAMED = r"(?i)\b(?:CVE-\d{4}-\d{4,}|CWE-\d+|GHSA-[A-Za-z0-9-]+|RFC\s*\d+|PEP\s*\d+)\b"
_VERSION = r"^\d+\.\d+(?:\.\d+)?$"
_LITERALS = (
    r"(?<!\w)(--[A-Za-z0-9][A-Za-z0-9_-]+)", r"\b([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+)\b", r"\b([A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+){2,})\b",
    r"\b([A-Za-z]*[a-z][A-Z][A-Za-z0-9]*)\b", r"\b([A-Z][A-Z0-9]{2,})\b",
)
_TOKEN = r"[A-Za-z][A-Za-z0-9_-]{2,}|[㐀-鿿]{2,}"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def _without(terms: Column, stops: tuple[str, ...]) -> Column:
    return F.array_except(terms, F.array(*[F.lit(s) for s in stops]))


def _is_han(c: Column) -> Column:
    return c.rlike("^[㐀-鿿]")


def _slices(run: Column, size: int) -> Column:
    every = F.transform(F.sequence(F.lit(1), F.length(run) - size + 1), lambda i: F.substring(run, i, F.lit(size)))
    return F.when(F.length(run) >= size, every).otherwise(F.array().cast("array<string>"))


def grams(run: Column, *sizes: int) -> Column:
    """All slices of ``run`` of the sizes, size by size."""
    return F.concat(*[_slices(run, n) for n in sizes])


def unquoted(c: Column) -> Column:
    """Text with its percent escapes decoded, or as it is where they are broken."""
    return F.coalesce(F.try_url_decode(F.replace(_text(c), F.lit("+"), F.lit("%2B"))), _text(c))


def strip_operators(c: Column) -> Column:
    """Query without URLs and site: operators, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(_text(c), r"(?i)https?://\S+", " "), r"(?i)(?:^|\s)site:[A-Za-z0-9.-]+", " ")
    return F.trim(F.regexp_replace(bare, r"[\s\p{Z}]+", " "))


def search_focus(c: Column) -> Column:
    """Query without one leading request to search; a leading site: operator and everything else stay."""
    raw = F.trim(F.regexp_replace(_text(c), r"[\s\p{Z}]+", " "))
    site, rest = F.regexp_extract(raw, r"(?i)^(site:[A-Za-z0-9.-]+)\s", 1), F.regexp_replace(raw, r"(?i)^site:[A-Za-z0-9.-]+\s+", "")
    cut = [F.trim(F.regexp_replace(rest, lead, "")) for lead in LEADS]
    usable = [(x != rest) & (F.length(x) >= 2) for x in cut]
    return F.trim(F.concat_ws(" ", F.nullif(site, F.lit("")), F.when(usable[0], cut[0]).when(usable[1], cut[1]).otherwise(rest)))


def plain_versions(c: Column) -> Column:
    """Version numbers of two or three parts that no further digit or dot adjoins, each once, in order."""
    return F.array_distinct(F.filter(_all(_text(c), "[0-9.]+"), lambda v: v.rlike(_VERSION)))


def fact_anchors(c: Column) -> Column:
    """Identifiers (CVE, CWE, GHSA, RFC, PEP) and versions that a text gives outside URLs, each once, identifiers first."""
    text = F.regexp_replace(_text(c), r"(?i)https?://\S+", " ")
    named = F.transform(_all(text, _NAMED), lambda x: F.lower(F.regexp_replace(x, r"\s+", "")))
    return F.array_distinct(F.concat(named, plain_versions(text)))


def literal_anchors(c: Column, most: int = 16) -> Column:
    """Flags, snake, kebab and camel case names and acronyms, lower-case, each once, kind by kind; the first ``most``."""
    text = strip_operators(c)
    found = F.transform(F.concat(*[_all(text, p, 1) for p in _LITERALS]), F.lower)
    return F.slice(_without(F.array_distinct(found), TOPIC_STOPS), 1, most)


def contains_anchor(c: Column, anchor: Column) -> Column:
    """Whether a text holds an anchor: a version as a number of its own, anything else with white space left out."""
    compact = F.lower(F.regexp_replace(_text(c), r"\s+", ""))
    return (anchor == "") | F.when(anchor.rlike(_VERSION), F.array_contains(plain_versions(c), anchor)).otherwise(F.contains(compact, anchor))


def locator_contains(c: Column, anchor: Column) -> Column:
    """:func:`contains_anchor`, or a version written with dashes, underscores or nothing between its parts, as in URLs."""
    slug = F.concat(F.lit("(?i)(?:^|[^0-9])v?"), F.replace(anchor, F.lit("."), F.lit("[-_.]?")), F.lit("(?:[^0-9]|$)"))
    return contains_anchor(c, anchor) | (anchor.rlike(_VERSION) & F.rlike(unquoted(c), slug))


def locator_versions(c: Column) -> Column:
    """Versions that a title or URL names, also with dashes or underscores, sorted."""
    text = unquoted(c)
    slugs = F.transform(_all(text, r"(?i)(?<!\d)v?(\d{1,3}[_-]\d{1,3}(?:[_-]\d{1,3})?)(?!\d)", 1), lambda v: F.translate(v, "_-", ".."))
    return F.array_sort(F.array_distinct(F.concat(plain_versions(text), slugs)))


def action_families(c: Column) -> Column:
    """Names of the actions that a text speaks of."""
    return F.array_compact(F.array(*[F.when(_text(c).rlike(p), F.lit(name)) for name, p in ACTIONS.items()]))


def actions_met(asked: Column, seen: Column) -> Column:
    """Whether one of the asked actions is met by one of the seen ones; true if none is asked."""
    return (F.size(asked) == 0) | reduce(Column.__or__, [F.array_contains(asked, a) & F.arrays_overlap(seen, F.array(*[F.lit(b) for b in by])) for a, by in MET_BY.items()])


def topic_terms(c: Column, domain: Column | None = None, most: int = 48) -> Column:
    """Terms for a coarse check of relevance, each once, in order: words, then short runs of ideographs and their 2- and 3-grams; the first ``most``.

    Search operators, stop words, parts of ``domain`` and anchors are left out.
    """
    text = strip_operators(c)
    words = F.transform(_all(text, r"[A-Za-z][A-Za-z0-9]*(?:[+_.-][A-Za-z0-9]+)*"), F.lower)
    han = reduce(lambda t, p: F.replace(t, F.lit(p), F.lit(" ")), TOPIC_PHRASES, text)
    runs = F.flatten(F.transform(_all(han, "[㐀-鿿]{2,}"), lambda r: F.concat(F.when(F.length(r) <= 12, F.array(r)).otherwise(F.array().cast("array<string>")), grams(r, 2, 3))))
    terms = _without(F.array_distinct(F.concat(words, runs)), TOPIC_STOPS)
    gone = fact_anchors(text) if domain is None else F.concat(fact_anchors(text), _all(F.lower(_text(domain)), "[a-z0-9]+"))
    return F.slice(F.array_except(terms, gone), 1, most)


def compact_terms(c: Column, stops: tuple[str, ...] = SIGNAL_STOPS) -> Column:
    """Words of three characters or more, and 2-grams of runs of ideographs, sorted, without stop words."""
    found = F.filter(F.transform(_all(_text(c), _TOKEN), F.lower), lambda t: ~t.isin(*stops))
    return F.array_sort(_without(F.array_distinct(F.flatten(F.transform(found, lambda t: F.when(_is_han(t), grams(t, 2)).otherwise(F.array(t))))), stops))


def latin_terms(c: Column, stops: tuple[str, ...] = SIGNAL_STOPS) -> Column:
    """Words of Latin letters, with c++ and c#, sorted, without stop words."""
    return F.array_sort(_without(F.array_distinct(F.transform(_all(_text(c), r"(?i)c\+\+|c#|[a-z][a-z0-9_+-]{2,}"), F.lower)), stops))


def signal_terms(c: Column) -> Column:
    """Terms that rank the sections of a page: words, parts of joined names, ideographs and their 2- to 4-grams, flags; sorted. A query that is one URL has none."""
    text = F.regexp_replace(_text(c), r"(?i)https?://[^\s<>\]\[()]+", " ")
    found = F.filter(F.transform(_all(text, _TOKEN), F.lower), lambda t: ~t.isin(*SIGNAL_STOPS))
    joined = r"^[a-z][a-z0-9]*(?:[_-][a-z0-9]+)+$"
    parts = F.flatten(F.transform(found, lambda t: F.concat(F.array(t), F.when(_is_han(t), grams(t, 2, 3, 4)).when(t.rlike(joined), F.split(t, "[_-]+")).otherwise(F.array().cast("array<string>")))))
    flags = F.transform(_all(text, r"(?<![A-Za-z0-9_])(--?[A-Za-z0-9][A-Za-z0-9-]*)", 1), F.lower)
    terms = F.filter(_without(F.array_distinct(F.concat(parts, flags)), SIGNAL_STOPS), lambda t: F.length(t) >= 2)
    return F.when(F.trim(_text(c)).rlike(r"(?i)^https?://\S+$"), F.array().cast("array<string>")).otherwise(F.array_sort(terms))


def quality_terms(c: Column) -> Column:
    """Words and runs of ideographs with their 2- to 4-grams, sorted, without stop words."""
    words = _without(F.transform(_all(_text(c), "[A-Za-z][A-Za-z0-9_-]{2,}"), F.lower), QUALITY_STOPS)
    runs = F.flatten(F.transform(_all(_text(c), "[㐀-鿿]{2,}"), lambda r: F.concat(F.array(r), grams(r, 2, 3, 4))))
    return F.array_sort(F.array_distinct(F.concat(words, runs)))


def body_signal(body: Column, query: Column) -> Column:
    """(n_terms, matched, signal): the query's terms that a body holds, and their share, rounded to 4 places."""
    terms = _without(F.array_distinct(_all(F.lower(_text(query)), "[a-z][a-z0-9_-]{2,}|[㐀-鿿]{2,}")), BODY_STOPS)
    low = F.lower(_text(body))
    matched = F.array_sort(F.filter(terms, lambda t: F.contains(low, t)))
    return F.struct(F.size(terms).alias("n_terms"), matched.alias("matched"), F.round(F.size(matched) / F.greatest(F.size(terms), F.lit(1)), 4).alias("signal"))


def is_noise(haystack: Column, terms: Column) -> Column:
    """Whether a row shows a sign of noise and none of the query's longer terms; false for a query without terms."""
    low = F.lower(_text(haystack))
    sign = reduce(Column.__or__, [F.contains(low, F.lit(n)) for n in NOISE])
    return (F.size(terms) > 0) & sign & ~F.exists(terms, lambda t: (F.length(t) > 4) & F.contains(low, t))


def relevance(title: Column, snippet: Column, url: Column, query: Column) -> Column:
    """(n_terms, n_hits, n_anchors, n_anchor_hits, version_conflict, related, score) of a row for a query.

    Related are rows with enough of the query's terms (2, or 1 of at most two; none are needed where a literal
    name of the query stands in the row), with one of its literal names if it has any, and without a version that
    contradicts the query's. A query of anchors only needs all of them in title or URL. The score is hits plus four for each anchor.
    """
    row, named = F.concat_ws(" ", *[_text(c) for c in (title, snippet, url)]), F.concat_ws(" ", _text(title), _text(url))
    folded = F.lower(unquoted(row))
    dashed = F.regexp_replace(folded, "[._/]+", "-")
    terms, anchors, literals = topic_terms(query), fact_anchors(query), literal_anchors(query)
    hits = F.size(F.filter(terms, lambda t: F.contains(folded, t) | F.contains(dashed, F.regexp_replace(t, "[._]+", "-"))))
    anchor_hits = F.size(F.filter(anchors, lambda a: locator_contains(named, a)))
    literal_hits = F.size(F.filter(literals, lambda a: F.contains(folded, a)))
    expected, shown = F.filter(anchors, lambda a: a.rlike(_VERSION)), locator_versions(named)
    conflict = (F.size(expected) > 0) & (F.size(shown) > 0) & ~F.arrays_overlap(expected, shown)
    need = F.when((F.size(terms) == 0) | (literal_hits > 0), 0).when(F.size(terms) <= 2, 1).otherwise(2)
    only = (F.size(anchors) > 0) & (F.size(terms) == 0)
    related = ~conflict & (hits >= need) & (~only | (anchor_hits == F.size(anchors))) & ((F.size(literals) == 0) | (literal_hits > 0))
    return F.struct(
        F.size(terms).alias("n_terms"), hits.alias("n_hits"), F.size(anchors).alias("n_anchors"), anchor_hits.alias("n_anchor_hits"),
        conflict.alias("version_conflict"), related.alias("related"), (hits + 4 * anchor_hits).alias("score"),
    )

"""URL columns: identities for deduplication, hosts and owners, and path predicates. All are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of query parameters that only track a visit.
TRACKING = ("utm_", "fbclid", "gclid", "msclkid")
TRACKING_FEWER = ("utm_", "fbclid", "gclid")
#: Hosts whose pages are lists of search results.
SEARCH_HOSTS = ("bing.com", "cn.bing.com", "duckduckgo.com", "html.duckduckgo.com")
#: Second labels under which two-letter domains are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org", "go", "gob", "or", "ne")

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), _URL, group)


def _tracked(key: Column, prefixes: tuple[str, ...]) -> Column:
    return F.lower(key).rlike("^(" + "|".join(prefixes) + ")")


def _form(value: Column) -> Column:
    """Value decoded and encoded again the one way that forms are encoded."""
    return F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(value), value)), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _query(raw: Column, prefixes: tuple[str, ...], grouped: bool) -> Column:
    """The query without tracking parameters; ``grouped``: values of a repeated key stand together."""
    pairs = F.transform(F.filter(F.split(raw, "&"), lambda p: p != ""), lambda p: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), F.regexp_extract(p, "^[^=]*=?(.*)$", 1).alias("v")))
    kept = F.filter(pairs, lambda p: ~_tracked(p["k"], prefixes))
    if grouped:
        keys = F.transform(kept, lambda p: p["k"])
        placed = F.transform(kept, lambda p, i: F.struct(F.array_position(keys, p["k"]).alias("first"), i.alias("i"), p["k"].alias("k"), p["v"].alias("v")))
        kept = F.array_sort(placed)
    return F.array_join(F.transform(kept, lambda p: F.concat(_form(p["k"]), F.lit("="), _form(p["v"]))), "&")


def _joined(scheme: Column, host: Column, path: Column, query: Column) -> Column:
    return F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _path(url: Column) -> Column:
    return F.coalesce(F.nullif(_part(url, 3), F.lit("")), F.lit("/"))


def normalise_url(url: Column) -> Column:
    """Absolute http(s) URL without fragment and tracking parameters; '' for anything else and null. Host case is kept."""
    scheme = F.lower(_part(url, 1))
    out = _joined(scheme, _part(url, 2), _path(url), _query(_part(url, 4), TRACKING, True))
    return F.when(scheme.isin("http", "https") & (_part(url, 2) != ""), out).otherwise("")


def url_identity(url: Column) -> Column:
    """:func:`normalise_url` with lower-case host and without slashes at the end of a path other than the root."""
    scheme = F.lower(_part(url, 1))
    path = F.coalesce(F.nullif(F.regexp_replace(_path(url), "/+$", ""), F.lit("")), F.lit("/"))
    out = _joined(scheme, F.lower(_part(url, 2)), path, _query(_part(url, 4), TRACKING, True))
    return F.when(scheme.isin("http", "https") & (_part(url, 2) != ""), out).otherwise("")


def canonical_url(url: Column) -> Column:
    """The identity for counting repeats: slashes and parameter order stay, and what has no scheme and host is kept raw."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    out = _joined(F.lower(_part(url, 1)), F.lower(_part(url, 2)), _path(url), _query(_part(url, 4), TRACKING_FEWER, False))
    return F.when(_part(url, 2) != "", out).otherwise(raw)


def plain_url(url: Column) -> Column:
    """Trimmed, lower-case, without slashes at the end."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), "/+$", "")


def host(url: Column) -> Column:
    """Lower-case host name without port, user, a leading www. and dots at the end; '' where there is none."""
    name = F.lower(F.regexp_replace(F.regexp_replace(_part(url, 2), "^.*@", ""), r":\d*$", ""))
    return F.regexp_replace(F.regexp_replace(name, r"\.+$", ""), r"^www\.", "")


def registrable(url: Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host(url), ".", -2)


def owner_label(url: Column) -> Column:
    """The label that names who controls the host: the one before the public suffix, letters and digits only."""
    labels = F.filter(F.split(host(url), r"\."), lambda p: p != "")
    n = F.size(labels)
    third = (n >= 3) & (F.length(F.try_element_at(labels, F.lit(-1))) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL)
    label = F.when(n < 2, F.try_element_at(labels, F.lit(-1))).when(third, F.try_element_at(labels, F.lit(-3))).otherwise(F.try_element_at(labels, F.lit(-2)))
    return F.regexp_replace(F.coalesce(label, F.lit("")), "[^a-z0-9]", "")


def host_within(name: Column, domain: Column) -> Column:
    """Whether a host is the domain or below it; false for empty ones."""
    return (name != "") & (domain != "") & ((name == domain) | name.endswith(F.concat(F.lit("."), domain)))


def host_suffixes(name: Column) -> Column:
    """A host and all domains above it, so that 'below a domain' becomes an equi-join."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def is_institutional(name: Column) -> Column:
    """Public-sector and academic host names."""
    return name.rlike(r"\.(gov|edu|mil|int)$|\.(gov|edu|mil|ac|go|gob)\.[a-z]{2,}$|\.gc\.ca$|\.gouv\.fr$")


def is_search_host(name: Column) -> Column:
    return name.rlike(r"(^|\.)(" + "|".join(h.replace(".", r"\.") for h in SEARCH_HOSTS) + ")$")


def is_download(url: Column) -> Column:
    """URLs of archives, installers, media and office files, by extension."""
    return F.lower(_part(url, 3)).rlike(r"\.(zip|gz|tgz|bz2|xz|7z|rar|tar|exe|msi|dmg|iso|apk|deb|rpm|mp3|mp4|avi|mov|png|jpe?g|gif|webp|svg|docx?|xlsx?|pptx?)$")


def is_pdf(url: Column) -> Column:
    return F.lower(_part(url, 3)).endswith(".pdf")


def path_date(url: Column) -> Column:
    """yyyy-mm-dd (day 01 where only a month is given) that a path names by convention; null if none."""
    path = _part(url, 3)
    year, month = F.regexp_extract(path, r"/(20\d\d|19\d\d)[/-](0?[1-9]|1[0-2])(?:[/-]|$)", 1), F.regexp_extract(path, r"/(20\d\d|19\d\d)[/-](0?[1-9]|1[0-2])(?:[/-]|$)", 2)
    day = F.regexp_extract(path, r"/(?:20\d\d|19\d\d)[/-](?:0?[1-9]|1[0-2])[/-](0?[1-9]|[12]\d|3[01])(?:[/-]|$)", 1)
    return F.when(year != "", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(F.coalesce(F.nullif(day, F.lit("")), F.lit("1")), 2, "0")))


def source_kind(url: Column, query: Column) -> Column:
    """github, arxiv, official (by words of the query) or web."""
    name = host(url)
    asked = F.lower(F.coalesce(query, F.lit(""))).rlike("official|官网|官方|release|文档|docs|pep")
    return F.when(name.rlike(r"(^|\.)github\.com$"), "github").when(name.contains("arxiv.org"), "arxiv").when(asked, "official").otherwise("web")


def domains_in(text: Column) -> Column:
    """Domain names that a text spells out, each once, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?:https?://|site:)?((?:[a-z0-9](?:[a-z0-9-]{0,62})\.)+[a-z]{2,63})"), 1)
    return F.array_distinct(F.transform(found, lambda d: F.regexp_replace(d, r"^www\.", "")))


def opaque_id(prefix: str, *parts: Column) -> Column:
    """Prefix and 20 hex digits of the SHA-256 of the parts, joined by line feeds."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 20))

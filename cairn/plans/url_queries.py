"""Queries on URLs, hosts and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import urls
from cairn.operators import ranking
from cairn.plans.catalog import query
from cairn.sources.tables import table

#: Common table expressions of the SQL side: URL parts, hosts and identities of the pages.
PARTS_SQL = r"""
WITH u AS (SELECT DISTINCT source_id, url, trim(coalesce(url, '')) AS raw FROM sources),
p AS (SELECT *, regexp_extract(raw, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', 1) AS s,
             regexp_extract(raw, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', 2) AS h,
             regexp_extract(raw, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', 3) AS d,
             regexp_extract(raw, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', 4) AS q FROM u),
k AS (SELECT *, list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|fbclid|gclid|msclkid)')) AS args,
             list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|fbclid|gclid)')) AS args2,
             coalesce(nullif(d, ''), '/') AS path,
             regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(h), '^.*@', ''), ':\d*$', ''), '\.+$', ''), '^www\.', '') AS host FROM p),
e AS (SELECT *, array_to_string(list_transform(args, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') AS query,
             array_to_string(list_transform(args2, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') AS query2,
             coalesce(nullif(regexp_replace(coalesce(nullif(d, ''), '/'), '/+$', ''), ''), '/') AS bare FROM k)
"""
IDENTITY_SQL = "CASE WHEN lower(s) IN ('http', 'https') AND h <> '' THEN lower(s) || '://' || lower(h) || bare || CASE WHEN query <> '' THEN '?' || query ELSE '' END ELSE '' END"


@query(
    PARTS_SQL
    + f"""SELECT source_id, CASE WHEN lower(s) IN ('http', 'https') AND h <> '' THEN lower(s) || '://' || h || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END ELSE '' END AS normalised,
       {IDENTITY_SQL} AS identity,
       CASE WHEN h <> '' THEN lower(s) || '://' || lower(h) || path || CASE WHEN query2 <> '' THEN '?' || query2 ELSE '' END ELSE raw END AS canonical,
       regexp_replace(lower(raw), '/+$', '') AS plain FROM e"""
)
def url_identities(spark: SparkSession, folder: str) -> DataFrame:
    """The four identities of each page's URL."""
    url = F.col("url")
    rows = table(spark, folder, "sources").select("source_id", "url").distinct()
    return rows.select("source_id", urls.normalise_url(url).alias("normalised"), urls.url_identity(url).alias("identity"), urls.canonical_url(url).alias("canonical"), urls.plain_url(url).alias("plain"))


@query(
    PARTS_SQL
    + r"""SELECT DISTINCT url, host, CASE WHEN len(string_split(host, '.')) >= 2 THEN array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') ELSE host END AS registrable,
       regexp_replace(CASE WHEN len(l) < 2 THEN coalesce(l[-1], '') WHEN len(l) >= 3 AND length(l[-1]) = 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org', 'go', 'gob', 'or', 'ne') THEN l[-3] ELSE l[-2] END, '[^a-z0-9]', '', 'g') AS owner,
       regexp_matches(host, '\.(gov|edu|mil|int)$|\.(gov|edu|mil|ac|go|gob)\.[a-z]{2,}$|\.gc\.ca$|\.gouv\.fr$') AS institutional,
       regexp_matches(host, '(^|\.)(bing\.com|cn\.bing\.com|duckduckgo\.com|html\.duckduckgo\.com)$') AS search_host,
       regexp_matches(lower(d), '\.(zip|gz|tgz|bz2|xz|7z|rar|tar|exe|msi|dmg|iso|apk|deb|rpm|mp3|mp4|avi|mov|png|jpe?g|gif|webp|svg|docx?|xlsx?|pptx?)$') AS download,
       ends_with(lower(d), '.pdf') AS pdf
FROM (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS l FROM e)"""
)
def host_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Host, owner and kind of each URL."""
    url = F.col("url")
    rows = table(spark, folder, "sources").select("url").distinct().withColumn("host", urls.host(url))
    return rows.select(
        "url", "host", urls.registrable(url).alias("registrable"), urls.owner_label(url).alias("owner"), urls.is_institutional(F.col("host")).alias("institutional"),
        urls.is_search_host(F.col("host")).alias("search_host"), urls.is_download(url).alias("download"), urls.is_pdf(url).alias("pdf"),
    )


@query(
    PARTS_SQL
    + f""", i AS (SELECT source_id, {IDENTITY_SQL} AS identity FROM e)
SELECT identity, min(source_id) AS first_source, count(*) AS n_sources FROM i WHERE identity <> '' GROUP BY identity"""
)
def url_identity_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The first page of each URL identity and how many share it; counted map-side, so a hot URL is no hot task."""
    rows = table(spark, folder, "sources").select("source_id", "url").distinct().select("source_id", urls.url_identity(F.col("url")).alias("identity"))
    return rows.where("identity <> ''").groupBy("identity").agg(F.min("source_id").alias("first_source"), F.count("*").alias("n_sources"))


@query(
    PARTS_SQL
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY source_id) AS place FROM e WHERE host <> '')
SELECT source_id, host, place FROM r WHERE place <= 3 ORDER BY place, source_id LIMIT 100"""
)
def host_quota_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The first hundred pages with at most three of one host, best place in its host first."""
    rows = table(spark, folder, "sources").select("source_id", "url").distinct().select("source_id", urls.host(F.col("url")).alias("host")).where("host <> ''")
    return ranking.quota_topk(rows, ["host"], [F.col("source_id")], per_key=3).orderBy("place", "source_id").limit(100)


@query(
    PARTS_SQL
    + """, f AS (SELECT host, count(*) AS n_pages, count(DISTINCT url) AS n_urls FROM e WHERE host <> '' GROUP BY host)
SELECT host, n_pages, n_urls, round(n_pages / sum(n_pages) OVER (), 6) AS share, n_pages = max(n_pages) OVER () AS dominant FROM f"""
)
def host_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and share of each host, and the dominant one."""
    rows = table(spark, folder, "sources").select("source_id", "url").distinct().withColumn("host", urls.host(F.col("url"))).where("host <> ''")
    counts = rows.groupBy("host").agg(F.count("*").alias("n_pages"), F.countDistinct("url").alias("n_urls"))
    total = counts.agg(F.sum("n_pages").alias("total"), F.max("n_pages").alias("most"))
    return counts.join(F.broadcast(total)).select("host", "n_pages", "n_urls", F.round(F.col("n_pages") / F.col("total"), 6).alias("share"), (F.col("n_pages") == F.col("most")).alias("dominant"))


@query(
    PARTS_SQL
    + r"""SELECT DISTINCT url, CASE WHEN y <> '' THEN y || '-' || lpad(m, 2, '0') || '-' || lpad(coalesce(nullif(a, ''), '1'), 2, '0') END AS path_date
FROM (SELECT url, regexp_extract(d, '/(20\d\d|19\d\d)[/-](0?[1-9]|1[0-2])(?:[/-]|$)', 1) AS y, regexp_extract(d, '/(20\d\d|19\d\d)[/-](0?[1-9]|1[0-2])(?:[/-]|$)', 2) AS m,
             regexp_extract(d, '/(?:20\d\d|19\d\d)[/-](?:0?[1-9]|1[0-2])[/-](0?[1-9]|[12]\d|3[01])(?:[/-]|$)', 1) AS a FROM e)"""
)
def url_path_dates(spark: SparkSession, folder: str) -> DataFrame:
    """The date that a URL's path names."""
    return table(spark, folder, "sources").select("url").distinct().select("url", urls.path_date(F.col("url")).alias("path_date"))


@query(
    PARTS_SQL
    + """, s AS (SELECT DISTINCT host FROM e WHERE host <> ''), o AS (SELECT DISTINCT CASE WHEN len(string_split(host, '.')) >= 2 THEN array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') ELSE host END AS domain FROM s)
SELECT o.domain, count(*) AS n_hosts FROM s JOIN o ON s.host = o.domain OR ends_with(s.host, '.' || o.domain) GROUP BY o.domain"""
)
def domain_suffix_join(spark: SparkSession, folder: str) -> DataFrame:
    """How many hosts lie in each registrable domain; the suffix condition is an equi-join on unfolded suffixes."""
    hosts = table(spark, folder, "sources").select(urls.host(F.col("url")).alias("host"), urls.registrable(F.col("url")).alias("domain")).where("host <> ''").distinct()
    below = hosts.select("host", F.explode(urls.host_suffixes(F.col("host"))).alias("domain"))
    return below.join(hosts.select("domain").distinct(), "domain").groupBy("domain").agg(F.count("*").alias("n_hosts"))


@query(
    r"""SELECT question_id, array_to_string(list_filter(list_transform(regexp_extract_all(lower(question), '(?:https?://|site:)?((?:[a-z0-9](?:[a-z0-9-]{0,62})\.)+[a-z]{2,63})', 1), lambda x: regexp_replace(x, '^www\.', '')), lambda x: true), ' ') AS domains
FROM eval_cases WHERE question IS NOT NULL"""
)
def question_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Domains that a question spells out."""
    return table(spark, folder, "eval_cases").where("question IS NOT NULL").select("question_id", F.array_join(urls.domains_in(F.col("question")), " ").alias("domains"))


@query("""SELECT DISTINCT source_id, 'S-' || substr(sha256(coalesce(task_id, '') || chr(10) || coalesce(content, '')), 1, 20) AS evidence_id, 'sha256:' || sha256(coalesce(content, '')) AS content_key FROM sources""")
def evidence_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Content-derived ids."""
    rows = table(spark, folder, "sources").select("source_id", "task_id", "content").distinct()
    return rows.select("source_id", urls.opaque_id("S-", F.col("task_id"), F.col("content")).alias("evidence_id"), F.concat(F.lit("sha256:"), F.sha2(F.coalesce("content", F.lit("")), 256)).alias("content_key")).distinct()


@query(
    r"""WITH l AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(page_excerpt, '\]\((https?://[^)\s]+)\)', 1)) AS link FROM evidence_items WHERE page_excerpt IS NOT NULL),
h AS (SELECT item_id, link, regexp_replace(lower(regexp_extract(link, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS host FROM l)
SELECT host, count(DISTINCT item_id) AS n_items, count(*) AS n_links FROM h GROUP BY host"""
)
def link_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts that the pages link to."""
    links = table(spark, folder, "evidence_items").where("page_excerpt IS NOT NULL").select("item_id", F.explode(F.regexp_extract_all("page_excerpt", F.lit(r"\]\((https?://[^)\s]+)\)"), 1)).alias("link")).distinct()
    return links.withColumn("host", urls.host(F.col("link"))).groupBy("host").agg(F.countDistinct("item_id").alias("n_items"), F.count("*").alias("n_links"))


@query(
    r"""WITH l AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '') AS a, regexp_replace(lower(regexp_extract(link, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS b
  FROM (SELECT url, unnest(regexp_extract_all(page_excerpt, '\]\((https?://[^)\s]+)\)', 1)) AS link FROM evidence_items WHERE page_excerpt IS NOT NULL)),
g AS (SELECT a, b FROM l WHERE a <> '' AND b <> '')
SELECT x.a AS seed, count(DISTINCT y.b) AS n_within_two FROM g x JOIN (SELECT a, b FROM g UNION SELECT b, b FROM g) y ON x.b = y.a GROUP BY x.a"""
)
def link_two_hop(spark: SparkSession, folder: str) -> DataFrame:
    """How many hosts are within two links of each host."""
    pages = table(spark, folder, "evidence_items").where("page_excerpt IS NOT NULL")
    edges = pages.select(urls.host(F.col("url")).alias("a"), F.explode(F.regexp_extract_all("page_excerpt", F.lit(r"\]\((https?://[^)\s]+)\)"), 1)).alias("link")).select("a", urls.host(F.col("link")).alias("b")).where("a <> '' AND b <> ''").distinct()
    onward = edges.select(F.col("a").alias("via"), F.col("b").alias("to")).union(edges.select("b", "b")).distinct()
    return edges.join(onward, F.col("b") == F.col("via")).groupBy(F.col("a").alias("seed")).agg(F.countDistinct("to").alias("n_within_two"))

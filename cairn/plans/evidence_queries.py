"""Queries on evidence: kinds, quality, identifiers, records inside texts, merges and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import evidence, terms, text, urls
from cairn.operators import merging, ordered, ranking
from cairn.plans.catalog import query
from cairn.plans.grounding_queries import _HOST
from cairn.plans.url_queries import IDENTITY_SQL, PARTS_SQL
from cairn.sources.tables import table

_PATH = r"lower(regexp_extract(trim(coalesce(url, '')), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1))"


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query(
    rf"""WITH k AS (SELECT DISTINCT item_id, url, snippet, source_excerpt, page_excerpt, body_verified, authority.rank AS rank, CASE WHEN lower(trim(coalesce(evidence_origin, ''))) IN {_in(evidence.BODY_ORIGINS)} THEN 'page_body'
  WHEN lower(trim(coalesce(evidence_origin, ''))) IN {_in(evidence.RECORD_ORIGINS)} THEN 'structured_record' WHEN lower(trim(coalesce(evidence_origin, ''))) IN {_in(evidence.FOUND_ORIGINS)} THEN 'discovery'
  WHEN trim(coalesce(source_excerpt, '')) <> '' OR trim(coalesce(page_excerpt, '')) <> '' THEN 'page_body_legacy' WHEN trim(coalesce(snippet, '')) <> '' THEN 'structured_record_legacy' ELSE 'discovery' END AS kind FROM evidence_items),
t AS (SELECT *, CASE WHEN starts_with(kind, 'page_body') THEN coalesce(CASE WHEN trim(coalesce(source_excerpt, '')) <> '' THEN trim(replace(source_excerpt, chr(13) || chr(10), chr(10))) END, CASE WHEN trim(coalesce(page_excerpt, '')) <> '' THEN trim(replace(page_excerpt, chr(13) || chr(10), chr(10))) END, '')
  WHEN starts_with(kind, 'structured_record') THEN trim(replace(snippet, chr(13) || chr(10), chr(10))) ELSE '' END AS body FROM k)
SELECT item_id, kind, md5(body) AS digest, round(CASE WHEN starts_with(kind, 'structured_record') THEN 3.0 WHEN starts_with(kind, 'page_body') THEN 2.0 ELSE 0 END + CASE WHEN body_verified THEN 1.0 ELSE 0 END + CASE WHEN length(body) >= 2000 THEN 0.5 ELSE 0 END
  + CASE WHEN regexp_matches({_HOST}, '\.(gov|edu|org)$') THEN 0.75 ELSE 0 END + least(1.5, coalesce(rank, 0) * 0.35), 4)::DOUBLE AS quality FROM t"""
)
def evidence_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Kind, text and quality of each evidence item; a snippet alone is a record only where no origin is stated."""
    rows = table(spark, folder, "evidence_items").select("item_id", "url", "snippet", "source_excerpt", "page_excerpt", "evidence_origin", "body_verified", F.col("authority.rank").alias("rank")).distinct()
    bodies, records = [F.col("source_excerpt"), F.col("page_excerpt")], [F.col("snippet")]
    rows = rows.withColumn("kind", evidence.evidence_kind(F.col("evidence_origin"), bodies, records))
    rows = rows.withColumn("body", evidence.evidence_text(F.col("kind"), bodies, records))
    return rows.select("item_id", "kind", F.md5(F.col("body").cast("binary")).alias("digest"), evidence.source_quality(F.col("kind"), F.col("body"), F.col("url"), F.col("body_verified"), F.col("rank")).alias("quality"))


@query(
    rf"""WITH u AS (SELECT DISTINCT s.source_id, s.url, lower(coalesce(t.content.goal, '')) AS goal FROM sources s LEFT JOIN training_tasks t USING (task_id)), p AS (SELECT *, {_HOST} AS host, {_PATH} AS path, regexp_matches(goal, 'document|docs|文档|api') AS doc, regexp_matches(goal, 'release|version|版本|发布') AS rel FROM u)
SELECT DISTINCT source_id, (regexp_matches(host, '(^|\.)v2ex\.com$') AND regexp_matches(path, '^/t/\d+/?$')) OR (regexp_matches(host, '(^|\.)reddit\.com$') AND contains(path, '/comments/')) OR (regexp_matches(host, '(^|\.)stackoverflow\.com$') AND regexp_matches(path, '^/questions/\d+')) AS community,
 CASE WHEN doc AND (regexp_matches(host, '^(docs|documentation|developer)\.') OR regexp_matches(path, '/(?:api|docs?|documentation|reference)(?:/|$)')) THEN 3 WHEN doc AND regexp_matches(path, '/(?:blog|news|announcements?|migrations?|releases?)(?:/|$)') THEN 0
 WHEN rel AND regexp_matches(path, '/(?:releases?|release-notes?|release_notes|changelog|downloads?)(?:/|$)') THEN 3 WHEN rel AND regexp_matches(path, '/(?:advanced|tutorial|examples?|community)(?:/|$)') THEN 0
 WHEN regexp_matches(path, '/(?:current|latest|stable)(?:/|$)') THEN 2 WHEN regexp_matches(path, '/(?:docs?|documentation)/v?\d+(?:\.\d+){{0,2}}(?:/|$)') THEN 0 ELSE 1 END AS path_rank FROM p"""
)
def path_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Community threads, and how well each page's path suits what its task's goal asks for."""
    goals = table(spark, folder, "training_tasks").select("task_id", F.lower(F.coalesce("content.goal", F.lit(""))).alias("goal"))
    rows = table(spark, folder, "sources").select("source_id", "task_id", "url").join(goals, "task_id", "left").withColumn("goal", F.coalesce("goal", F.lit("")))
    doc, rel = F.col("goal").rlike("document|docs|文档|api"), F.col("goal").rlike("release|version|版本|发布")
    return rows.select("source_id", F.coalesce(evidence.is_community_detail(F.col("url")), F.lit(False)).alias("community"), evidence.path_rank(F.col("url"), doc, rel).alias("path_rank")).distinct()


_LINKS = r"list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?i)https?://[^\s<>\[\]()\x22'']+'), lambda u: regexp_replace(u, '[.,;:!?]+$', '')), lambda u: regexp_matches(u, '(?i)^https?://[^/?#]'))"


@query(
    rf"""WITH d AS (SELECT doc_id, text, {_LINKS} AS l FROM documents), u AS (SELECT doc_id, CASE WHEN len(l) = 1 THEN l[1] ELSE '' END AS single, list_distinct(list_concat(
 list_transform(regexp_extract_all(coalesce(text, ''), '(?i)https?://(?:www\.)?crates\.io/crates/([^/\s?#]+)', 1), lambda x: 'crates:' || lower(x)), list_transform(regexp_extract_all(coalesce(text, ''), '(?i)https?://(?:www\.)?pypi\.org/project/([^/\s?#]+)', 1), lambda x: 'pypi:' || lower(x)),
 list_transform(regexp_extract_all(coalesce(text, ''), '(?i)(?:^|[^0-9A-Za-z_.])(?:arXiv\s*:\s*)?(\d{{4}}\.\d{{4,5}})(?:v\d+)?(?:[^0-9A-Za-z_.]|$)', 1), lambda x: 'arxiv:' || x), list_transform(regexp_extract_all(coalesce(text, ''), '(?i)(?:^|[^0-9A-Za-z_])(CVE-\d{{4}}-\d{{4,}})', 1), lambda x: 'cve:' || lower(x)))) AS ids FROM d)
SELECT doc_id, single <> '' AS has_single_url, coalesce(array_to_string(list_sort(ids), '|'), '') AS object_ids FROM u"""
)
def text_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Typed identifiers in each document, and whether it names exactly one URL."""
    rows = table(spark, folder, "documents").select("doc_id", "text")
    return rows.select("doc_id", (evidence.single_url(F.col("text")) != "").alias("has_single_url"), F.array_join(F.array_sort(evidence.object_ids(F.col("text"))), "|").alias("object_ids"))


@query(
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), 'https?://[^)\s]+') AS l FROM documents)
SELECT doc_id, regexp_matches(t, '"""
    + evidence.REFUSAL
    + "') AS refusal, regexp_matches(t, '"
    + evidence.PROTOCOL.replace("(?i)", "(?i)", 1)
    + "') AS protocol, regexp_matches(t, '"
    + evidence.NAVIGATION
    + r"""') AS navigation, len(list_filter(list_distinct(l), lambda u: len(list_filter(l, lambda v: v = u)) > 2)) > 0 AS repeated_url FROM d"""
)
def answer_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Refusals, prompt and menu remains and URLs named three times, in each document."""
    return table(spark, folder, "documents").select("doc_id", F.explode(F.array(evidence.answer_flags(F.col("text")))).alias("f")).select("doc_id", "f.*")


@query(
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([。！？；;\n])', '\1' || chr(1), 'g'), chr(1)), lambda u: u <> '') AS a, string_split(regexp_replace(t, '([，,])', '\1' || chr(1), 'g'), chr(1)) AS b FROM d),
u AS (SELECT doc_id, list_filter(list_transform(CASE WHEN len(a) > 1 THEN a ELSE b END, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS units FROM s)
SELECT doc_id, len(units) AS n_units, md5(array_to_string(units, chr(1))) AS digest FROM u"""
)
def document_units(spark: SparkSession, folder: str) -> DataFrame:
    """Number and digest of the units of each document: what stands between full stops, or between commas where there are none."""
    rows = table(spark, folder, "documents").select("doc_id", F.explode(F.array(evidence.text_units(F.col("text")))).alias("u"))
    return rows.select("doc_id", F.size("u").alias("n_units"), F.md5(F.array_join("u", "\x01").cast("binary")).alias("digest"))


@query(
    r"""WITH d AS (SELECT DISTINCT source_id, coalesce(content, '') AS t FROM sources), x AS (SELECT source_id, regexp_extract(t, '((?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))', 1) AS day, regexp_extract(t, '((?:19|20)\d{2})\s*年\s*(1[0-2]|0?[1-9])\s*月', 1) AS y, regexp_extract(t, '((?:19|20)\d{2})\s*年\s*(1[0-2]|0?[1-9])\s*月', 2) AS m,
 regexp_extract(t, '(?i)(?:^|[^A-Za-z])(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?\s+((?:19|20)\d{2})', 1) AS em,
 regexp_extract(t, '(?i)(?:^|[^A-Za-z])(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?\s+((?:19|20)\d{2})', 2) AS ey FROM d)
SELECT DISTINCT source_id, CASE WHEN try_cast(nullif(day, '') AS DATE) IS NOT NULL THEN day WHEN y <> '' THEN y || '-' || lpad(m, 2, '0') || '-01' WHEN em <> '' THEN ey || '-' || lpad(CAST(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(em[1:3])) AS VARCHAR), 2, '0') || '-01' END AS start,
 CASE WHEN try_cast(nullif(day, '') AS DATE) IS NOT NULL THEN 'day' WHEN y <> '' OR em <> '' THEN 'month' END AS precision FROM x"""
)
def record_periods(spark: SparkSession, folder: str) -> DataFrame:
    """The first day or month that each page names."""
    rows = table(spark, folder, "sources").select("source_id", F.explode(F.array(evidence.record_period(F.col("content")))).alias("p"))
    return rows.select("source_id", "p.*").distinct()


_HTML = "'<html><nav>' || coalesce(title, '') || '</nav>' || CASE WHEN source_id LIKE '%1' THEN '<article>' || coalesce(content, '') || '</article>' WHEN source_id LIKE '%2' THEN '<main>x</main><article>' || coalesce(content, '') || '</article>' ELSE '<main id=\"a\">' || coalesce(content, '') || '</main><main>b</main>' END || '</html>'"


@query(
    rf"""WITH h AS (SELECT DISTINCT source_id, {_HTML} AS html FROM sources), r AS (SELECT source_id, html, list_sort(list_transform(regexp_extract_all(html, '(?is)<main\b[^>]*>.*?</main\s*>'), lambda x: {{'n': length(x), 'x': x}}), 'DESC')[1].x AS main, list_sort(list_transform(regexp_extract_all(html, '(?is)<article\b[^>]*>.*?</article\s*>'), lambda x: {{'n': length(x), 'x': x}}), 'DESC')[1].x AS article FROM h)
SELECT DISTINCT source_id, md5(CASE WHEN length(main) >= 256 THEN main WHEN length(article) >= 256 THEN article ELSE html END) AS digest FROM r"""
)
def primary_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of the main region of each page, its text being set into simple HTML."""
    c, t = F.coalesce("content", F.lit("")), F.coalesce("title", F.lit(""))
    body = F.when(F.col("source_id").endswith("1"), F.concat(F.lit("<article>"), c, F.lit("</article>"))).when(F.col("source_id").endswith("2"), F.concat(F.lit("<main>x</main><article>"), c, F.lit("</article>"))).otherwise(F.concat(F.lit('<main id="a">'), c, F.lit("</main><main>b</main>")))
    html = F.concat(F.lit("<html><nav>"), t, F.lit("</nav>"), body, F.lit("</html>"))
    return table(spark, folder, "sources").select("source_id", F.md5(evidence.primary_content(html).cast("binary")).alias("digest")).distinct()


@query(
    r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '(?m)^(#{1,6}[ \t]+[^\n]+)$', chr(1) || '\1', 'g'), chr(1)) AS parts FROM documents WHERE NOT contains(coalesce(text, ''), chr(1))),
s AS (SELECT doc_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i, parts FROM p), o AS (SELECT doc_id, part, CAST(coalesce(list_sum(list_transform(parts[:i - 1], lambda x: length(x))), 0) AS INT) AS char_start, len(list_filter(parts, lambda x: regexp_matches(x, '^#{1,6}[ \t]+[^\n]'))) > 0 AS headed FROM s)
SELECT doc_id, char_start, CASE WHEN regexp_matches(part, '^#{1,6}[ \t]+[^\n]') THEN 'heading_section' WHEN headed THEN 'preamble' ELSE 'semantic_window' END AS kind, md5(part) AS digest FROM o WHERE NOT regexp_full_match(part, '\s*')"""
)
def section_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The sections of each document with their places."""
    rows = table(spark, folder, "documents").where("NOT contains(coalesce(text, ''), char(1))").select("doc_id", F.explode(evidence.sections(F.col("text"))).alias("s"))
    return rows.select("doc_id", "s.char_start", "s.kind", F.md5(F.col("s.text").cast("binary")).alias("digest"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line_no FROM documents),
n AS (SELECT *, coalesce(lead(x) OVER w, '') AS after, coalesce(lag(x) OVER w, '') AS before FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), k AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(x, '^\s*\|.*\|.*\|') AND NOT regexp_matches(x, '^\s*\|(?:\s*:?-{2,}:?\s*\|)+\s*$') AND NOT regexp_matches(after, '^\s*\|(?:\s*:?-{2,}:?\s*\|)+\s*$') THEN 'table_record'
 WHEN regexp_matches(x, '(?i)^\s*`--?[A-Za-z0-9]') AND NOT regexp_matches(before, '(?i)^\s*`--?[A-Za-z0-9]') THEN 'option_record' END AS kind FROM n) SELECT * FROM k WHERE kind IS NOT NULL"""
)
def structural_records(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents that are records of their own: table rows and option descriptions."""
    return table(spark, folder, "documents").select("doc_id", F.explode(evidence.record_lines(F.col("text"))).alias("r")).select("doc_id", "r.*")


@query(
    r"""WITH r AS (SELECT DISTINCT item_id, url, snippet, trim(regexp_replace(lower(coalesce(snippet, '')), '[\s\p{Z}]+', ' ', 'g')) AS key FROM evidence_items), f AS (SELECT * FROM r WHERE key <> ''),
i AS (SELECT key, item_id, row_number() OVER (PARTITION BY key ORDER BY item_id) AS place FROM (SELECT DISTINCT key, item_id FROM f))
SELECT key, count(*) AS n, arg_max(snippet, (length(snippet), snippet)) AS snippet, min(item_id) AS first_item, any_value(l.ids) AS ids FROM f JOIN (SELECT key, array_to_string(list(item_id ORDER BY place), '|') AS ids FROM i WHERE place <= 8 GROUP BY key) l USING (key) GROUP BY key"""
)
def merged_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Snippets merged by their normal form: the longest one and the first eight items that have it."""
    rows = table(spark, folder, "evidence_items").select("item_id", "url", "snippet").distinct().withColumn("key", text.spaced(F.col("snippet"))).where("key <> ''")
    out = merging.merged_candidates(rows, ["key"], "snippet", ["item_id"], "item_id")
    return out.select("key", "n", "snippet", F.col("first.item_id").alias("first_item"), F.array_join(F.transform("ids", lambda x: x.cast("string")), "|").alias("ids"))


@query(
    r"""WITH s AS (SELECT DISTINCT source_id, task_id, ingested_at, content FROM sources WHERE task_id IS NOT NULL), h AS (SELECT *, len(regexp_extract_all(lower(coalesce(content, '')), 'evidence|token|证据|令牌')) AS score, regexp_matches(coalesce(content, ''), '\d{4}-\d{2}-\d{2}') AS dated FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, source_id, ingested_at) AS place, dated AND row_number() OVER (PARTITION BY task_id ORDER BY dated DESC, ingested_at DESC NULLS LAST, source_id) = 1 AS kept FROM h),
a AS (SELECT *, max(CAST(kept AND place > 3 AS INT)) OVER (PARTITION BY task_id) AS away FROM p) SELECT task_id, source_id, score, CASE WHEN place > 3 THEN 0 ELSE place END AS place FROM a WHERE place <= 3 - away OR kept"""
)
def reserved_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The three pages of each task with most hits, one place being kept for the newest dated page."""
    rows = table(spark, folder, "sources").where("task_id IS NOT NULL").select("source_id", "task_id", "ingested_at", "content").distinct()
    rows = rows.withColumn("score", F.regexp_count(F.lower(F.coalesce("content", F.lit(""))), F.lit("evidence|token|证据|令牌"))).withColumn("dated", F.coalesce("content", F.lit("")).rlike(r"\d{4}-\d{2}-\d{2}"))
    out = merging.reserved_topk(rows, ["task_id"], [F.desc("score"), F.asc("source_id"), F.asc("ingested_at")], F.col("dated"), [F.desc_nulls_last("ingested_at"), F.asc("source_id")], 3)
    return out.select("task_id", "source_id", "score", "place")


@query(
    """WITH RECURSIVE d AS (SELECT DISTINCT host, doc_id, n_chars FROM documents WHERE host IS NOT NULL AND n_chars BETWEEN 0 AND 6000), o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY doc_id) AS i FROM d),
w AS (SELECT host, CAST(0 AS BIGINT) AS i, CAST(6000 AS BIGINT) AS room, CAST(NULL AS BIGINT) AS doc_id FROM (SELECT DISTINCT host FROM d) UNION ALL SELECT o.host, o.i, CASE WHEN o.n_chars <= w.room THEN w.room - o.n_chars ELSE w.room END, CASE WHEN o.n_chars <= w.room THEN o.doc_id END FROM w JOIN o ON o.host = w.host AND o.i = w.i + 1)
SELECT host, doc_id FROM w WHERE doc_id IS NOT NULL"""
)
def packed_context(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each host that fit into 6,000 characters, in order, skipping those that no longer fit."""
    rows = table(spark, folder, "documents").where("host IS NOT NULL").select("host", "doc_id", "n_chars").distinct()
    return merging.packed(rows, ["host"], ["doc_id"], "n_chars", 6000).select("host", "doc_id")


@query(
    PARTS_SQL.replace("SELECT DISTINCT source_id, url,", "SELECT DISTINCT source_id, task_id, title, content, authority, url,")
    + f""", i AS (SELECT task_id, source_id, CASE WHEN {IDENTITY_SQL} <> '' THEN 'url:' || {IDENTITY_SQL} WHEN coalesce(content, '') <> '' THEN 'sha256:' || sha256(content) WHEN trim(coalesce(title, '')) <> '' THEN 'title:' || trim(regexp_replace(lower(title), '[\\s\\p{{Z}}]+', ' ', 'g')) ELSE '' END AS identity FROM e WHERE task_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY source_id) AS rank FROM (SELECT DISTINCT task_id, source_id, identity FROM i)), b AS (SELECT task_id, identity, min(rank) AS best_rank, count(*) AS n FROM r WHERE identity <> '' GROUP BY 1, 2)
SELECT r.task_id, r.source_id, r.identity, coalesce(b.best_rank, 0) AS best_rank, coalesce(b.n, 0) AS n_same FROM r LEFT JOIN b USING (task_id, identity)"""
)
def source_identities(spark: SparkSession, folder: str) -> DataFrame:
    """Each page's identity (URL, else digest, else title) in its task, with the best rank and number of pages of that identity."""
    rows = table(spark, folder, "sources").where("task_id IS NOT NULL").select("source_id", "task_id", "title", "content", "url").distinct()
    by_url, named = urls.url_identity(F.col("url")), text.spaced(F.col("title"))
    identity = F.when(by_url != "", F.concat(F.lit("url:"), by_url)).when(F.coalesce("content", F.lit("")) != "", F.concat(F.lit("sha256:"), F.sha2("content", 256))).when(named != "", F.concat(F.lit("title:"), named)).otherwise("")
    once = rows.select("task_id", "source_id", identity.alias("identity")).distinct()
    ranked = ordered.numbered(once, ["task_id"], ["source_id", "identity"], "rank")
    best = ranked.where("identity <> ''").groupBy("task_id", "identity").agg(F.min("rank").alias("best_rank"), F.count("*").alias("n_same"))
    return ranked.join(best, ["task_id", "identity"], "left").select("task_id", "source_id", "identity", F.coalesce("best_rank", F.lit(0)).alias("best_rank"), F.coalesce("n_same", F.lit(0)).alias("n_same"))


@query(
    r"""WITH p AS (SELECT DISTINCT s.source_id, s.task_id, s.title, s.content, t.content.goal AS goal FROM sources s JOIN training_tasks t USING (task_id)), k AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY source_id, content) AS rank, list_distinct(list_concat(
 list_filter(list_transform(regexp_extract_all(coalesce(goal, ''), '[A-Za-z][A-Za-z0-9_-]{2,}'), lambda x: lower(x)), lambda x: NOT list_contains("""
    + "['" + "', '".join(terms.QUALITY_STOPS) + "']"
    + r""", x)), flatten(list_transform(regexp_extract_all(coalesce(goal, ''), '[㐀-鿿]{2,}'), lambda r: list_concat([r], flatten(list_transform([2, 3, 4], lambda n: list_transform(range(1, greatest(length(r) - n + 2, 1)), lambda i: substr(r, CAST(i AS INT), CAST(n AS INT)))))))))) AS terms,
 len(list_distinct(list_filter(regexp_extract_all(coalesce(content, ''), '\b(\d{4}-\d{2}-\d{2})\b', 1), lambda d: try_cast(d AS DATE) IS NOT NULL))) AS days FROM p)
SELECT source_id, task_id, rank, round(0.35 * least(1.0::DOUBLE, len(list_filter(terms, lambda t: contains(lower(coalesce(title, '') || ' ' || coalesce(content, '')), t))) / greatest(1, least(len(terms), 8))) + 0.25 * least(1.0::DOUBLE, length(coalesce(content, '')) / 1200) + 0.2 + 0.1 / greatest(rank, 1) + 0.1 * least(1.0::DOUBLE, days / 3), 8) AS score FROM k"""
)
def evidence_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A quality score of each page for its task's goal: terms, body, rank and dates."""
    goals = table(spark, folder, "training_tasks").select("task_id", F.col("content.goal").alias("goal"))
    rows = table(spark, folder, "sources").select("source_id", "task_id", "title", "content").join(goals, "task_id").distinct()
    ranked = ordered.numbered(rows, ["task_id"], ["source_id", "content"], "rank")
    hay = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    score = evidence.quality_score(hay, F.col("content"), terms.quality_terms(F.col("goal")), F.col("rank"), F.size(text.dates_in(F.col("content"))), 8)
    return ranked.select("source_id", "task_id", "rank", score.alias("score"))


@query(
    r"""WITH s AS (SELECT DISTINCT task_id, source_id, md5(trim(coalesce(content, ''))) AS digest, length(content) AS n FROM sources WHERE task_id IS NOT NULL AND trim(coalesce(content, '')) <> ''), d AS (SELECT task_id, digest, min(source_id) AS source_id, max(n) AS n FROM s GROUP BY 1, 2)
SELECT task_id, source_id, n, row_number() OVER (PARTITION BY task_id ORDER BY n DESC, source_id) AS place FROM d QUALIFY place <= 6"""
)
def distinct_text_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The six longest different texts of each task."""
    rows = table(spark, folder, "sources").where("task_id IS NOT NULL AND trim(coalesce(content, '')) <> ''")
    once = rows.groupBy("task_id", F.md5(F.trim("content").cast("binary")).alias("digest")).agg(F.min("source_id").alias("source_id"), F.max(F.length("content")).alias("n"))
    return ranking.quota_topk(once, ["task_id"], [F.desc("n"), F.asc("source_id")], 6).select("task_id", "source_id", "n", "place")

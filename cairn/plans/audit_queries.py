"""Queries that audit answers, claims, calls and tasks, and read candidates out of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import audits, evidence, terms, text
from cairn.operators import merging, ordered
from cairn.plans.catalog import query
from cairn.plans.text_queries import TERMS_SQL
from cairn.sources.tables import table


@query(
    r"""SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '(?:^|[\s,;|（(])([A-Za-z_][A-Za-z0-9_]{1,23}|[㐀-鿿]{1,12})[ \t]*[:：=][ \t]*([^\s,;，；。|/][^\s,;，；。|]*)', 1), lambda x: lower(x)))), '|'), '') AS labels,
 len(regexp_extract_all(coalesce(text, ''), '\d+(?:\.\d+)?[ \t]*(?:%|ms|MB|GB|days?|hours?|条|组|秒|天)')) AS n_quantities FROM documents"""
)
def text_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Labels that have a value, and the number of quantities with a unit, in each document."""
    labels = F.array_sort(F.array_distinct(F.transform(audits.labelled_values(F.col("text")), lambda p: F.lower(p["label"]))))
    return table(spark, folder, "documents").select("doc_id", F.array_join(labels, "|").alias("labels"), F.size(audits.quantities(F.col("text"))).alias("n_quantities"))


_CLAIMS = r"list_concat(list_transform(list_filter(list_distinct(regexp_extract_all(coalesce({0}, ''), '\b(\d{{4}}-\d{{2}}-\d{{2}})\b', 1)), lambda d: try_cast(d AS DATE) IS NOT NULL), lambda d: 'date:' || d), list_transform(list_distinct(list_filter(regexp_extract_all(coalesce({0}, ''), '[0-9.]+'), lambda v: regexp_full_match(v, '\d+\.\d+(\.\d+)?'))), lambda v: 'version:' || v))"


@query(
    rf"""WITH t AS (SELECT DISTINCT task_id, {_CLAIMS.format("coalesce(content.goal, '') || chr(10) || coalesce(instruction, '')")} AS c FROM training_tasks WHERE task_id IS NOT NULL), c AS (SELECT DISTINCT task_id, unnest(c) AS claim FROM t), s AS (SELECT DISTINCT task_id, unnest({_CLAIMS.format("content")}) AS claim FROM sources WHERE task_id IS NOT NULL)
SELECT c.task_id, c.claim, s.claim IS NOT NULL AS supported FROM c LEFT JOIN s USING (task_id, claim)"""
)
def claim_support(spark: SparkSession, folder: str) -> DataFrame:
    """Dates and versions in each task's texts, and whether a page of the task has them."""
    tasks = table(spark, folder, "training_tasks").where("task_id IS NOT NULL").select("task_id", F.concat_ws("\n", F.coalesce("content.goal", F.lit("")), F.coalesce("instruction", F.lit(""))).alias("t"))
    claims = tasks.select("task_id", F.explode(audits.literal_claims(F.col("t"))).alias("claim")).distinct()
    known = table(spark, folder, "sources").where("task_id IS NOT NULL").select("task_id", F.explode(audits.literal_claims(F.col("content"))).alias("claim")).distinct().withColumn("known", F.lit(True))
    return claims.join(known, ["task_id", "claim"], "left").select("task_id", "claim", F.col("known").isNotNull().alias("supported"))


@query(
    r"""WITH t AS (SELECT DISTINCT task_id FROM training_tasks WHERE task_id IS NOT NULL), s AS (SELECT DISTINCT source_id, task_id, url, title, content, authority FROM sources WHERE task_id IS NOT NULL),
a AS (SELECT task_id, count(*) AS n_results, count(DISTINCT regexp_replace(lower(trim(coalesce(url, ''))), '/+$', '')) AS n_urls, round(count(*) FILTER (trim(coalesce(content, '')) <> '') / count(*), 4) AS body_rate, round(count(*) FILTER (authority = 'official') / count(*), 4) AS official_rate, round(avg(length(coalesce(content, ''))), 2) AS mean_chars FROM s GROUP BY 1)
SELECT t.task_id, coalesce(n_results, 0) AS n_results, coalesce(n_urls, 0) AS n_urls, body_rate, official_rate, mean_chars, CASE WHEN n_results > 0 THEN round((n_results - n_urls) / n_results, 4) END AS duplicate_rate FROM t LEFT JOIN a USING (task_id)"""
)
def task_scores(spark: SparkSession, folder: str) -> DataFrame:
    """One row of metrics for each task: results, different URLs, bodies, official pages, sizes, duplicates."""
    from cairn.functions import urls

    tasks = table(spark, folder, "training_tasks").where("task_id IS NOT NULL").select("task_id").distinct()
    pages = table(spark, folder, "sources").where("task_id IS NOT NULL").select("source_id", "task_id", "url", "title", "content", "authority").distinct()
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 4)
    sums = pages.groupBy("task_id").agg(F.count("*").alias("n_results"), F.count_distinct(urls.plain_url(F.col("url"))).alias("n_urls"), share(F.trim(F.coalesce("content", F.lit(""))) != "").alias("body_rate"), share(F.col("authority") == "official").alias("official_rate"), F.round(F.avg(F.length(F.coalesce("content", F.lit("")))), 2).alias("mean_chars"))
    out = tasks.join(sums, "task_id", "left").withColumn("duplicate_rate", F.when(F.col("n_results") > 0, F.round((F.col("n_results") - F.col("n_urls")) / F.col("n_results"), 4)))
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_results", "n_urls")})


_HOSTS = r"list_distinct(list_transform(regexp_extract_all(lower(coalesce({0}, '')), '(?:site:|https?://)([a-z0-9-]+(?:\.[a-z0-9-]+)+)', 1), lambda x: 'host:' || x))"


@query(
    rf"""WITH p AS (SELECT DISTINCT s.source_id, list_concat({_HOSTS.format("t.content.goal")}, list_transform({_CLAIMS.format("t.content.goal")}, lambda x: x)) AS asked, list_concat({_HOSTS.format("s.url")}, {_CLAIMS.format("s.content")}) AS seen FROM sources s JOIN training_tasks t USING (task_id)),
n AS (SELECT *, list_distinct(list_transform(asked, lambda x: split_part(x, ':', 1))) AS a, list_distinct(list_transform(seen, lambda x: split_part(x, ':', 1))) AS b FROM p)
SELECT DISTINCT source_id, CASE WHEN len(asked) = 0 THEN 'not_requested' WHEN list_has_any(asked, seen) THEN 'exact' WHEN list_has_any(a, b) THEN 'conflict' ELSE 'unresolved' END AS alignment FROM n"""
)
def object_alignments(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each page is about the hosts, dates and versions that its task's goal names: exact, of another value (conflict), or unresolved."""
    goals = table(spark, folder, "training_tasks").select("task_id", F.col("content.goal").alias("goal"))
    rows = table(spark, folder, "sources").select("source_id", "task_id", "url", "content").join(goals, "task_id")
    asked = F.concat(audits.named_hosts(F.col("goal")), audits.literal_claims(F.col("goal")))
    seen = F.concat(audits.named_hosts(F.col("url")), audits.literal_claims(F.col("content")))
    return rows.select("source_id", audits.alignment(asked, seen).alias("alignment")).distinct()


@query(
    r"""WITH r AS (SELECT DISTINCT item_id, title, url FROM evidence_items WHERE trim(coalesce(title, '')) <> ''), s AS (SELECT item_id, 'SPAN-' || substr(sha256(coalesce(url, '') || chr(10) || title), 1, 20) AS span_id FROM r), p AS (SELECT DISTINCT span_id, item_id FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY item_id) AS place FROM p)
SELECT span_id, count(*) AS n_items, array_to_string(list(item_id ORDER BY item_id) FILTER (place <= 8), '|') AS items FROM o GROUP BY span_id"""
)
def span_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record for each different title at a URL, under an opaque id, with the first eight items that have it."""
    from cairn.functions import urls

    rows = table(spark, folder, "evidence_items").where("trim(coalesce(title, '')) <> ''").select("item_id", "title", "url").distinct()
    rows = rows.select("item_id", urls.opaque_id("SPAN-", F.col("url"), F.col("title")).alias("span_id"))
    counts = rows.distinct().groupBy("span_id").agg(F.count("*").alias("n_items"))
    first = merging.first_distinct(rows, ["span_id"], "item_id", ["item_id"], 8, "items")
    return counts.join(first, "span_id").select("span_id", "n_items", F.array_join(F.transform("items", lambda x: x.cast("string")), "|").alias("items"))


@query(
    r"""WITH r AS (SELECT DISTINCT source_id, task_id, regexp_extract(lower(trim(coalesce(url, ''))), '^[a-z]+://([^/?#:]+)', 1) AS host, trim(regexp_replace(lower(coalesce(title, '')), '[\s\p{Z}]+', ' ', 'g')) AS t FROM sources WHERE task_id IS NOT NULL), g AS (SELECT task_id, substr(sha256(host || chr(10) || t), 1, 20) AS object_id, count(DISTINCT source_id) AS n, min(source_id) AS first_seen FROM r GROUP BY 1, 2)
SELECT task_id, object_id, n, row_number() OVER (PARTITION BY task_id ORDER BY first_seen, object_id) AS place FROM g"""
)
def object_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of each task grouped by host and title, in the order in which the groups are first seen."""
    host = F.regexp_extract(F.lower(F.trim(F.coalesce("url", F.lit("")))), r"^[a-z]+://([^/?#:]+)", 1)
    rows = table(spark, folder, "sources").where("task_id IS NOT NULL").select("source_id", "task_id", F.substring(F.sha2(F.concat_ws("\n", host, text.spaced(F.col("title"))), 256), 1, 20).alias("object_id")).distinct()
    groups = rows.groupBy("task_id", "object_id").agg(F.count_distinct("source_id").alias("n"), F.min("source_id").alias("first_seen"))
    return ordered.numbered(groups, ["task_id"], ["first_seen", "object_id"], "place").select("task_id", "object_id", "n", "place")


@query(
    """WITH c AS (SELECT question_id, any_value(persona) AS persona, any_value(difficulty) AS difficulty FROM (SELECT DISTINCT question_id, persona, difficulty FROM eval_cases) GROUP BY 1), u AS (SELECT question_id, 'reviewed' AS persona FROM c WHERE question_id LIKE '%5' UNION ALL SELECT 'new-1', 'added')
SELECT coalesce(c.question_id, u.question_id) AS question_id, coalesce(u.persona, c.persona) AS persona, c.difficulty, u.question_id IS NOT NULL AS changed FROM c FULL JOIN u ON c.question_id = u.question_id"""
)
def upserted_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The cases after some were reviewed and one was added; values that a change leaves null stay."""
    cases = table(spark, folder, "eval_cases").select("question_id", "persona", "difficulty").distinct()
    changes = cases.where("question_id LIKE '%5'").select("question_id", F.lit("reviewed").alias("persona")).unionByName(spark.range(1).select(F.lit("new-1").alias("question_id"), F.lit("added").alias("persona")))
    return audits.upserted(cases, changes, "question_id", "changed")


@query(
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, regexp_full_match(t, '[\s\p{Z}]*') AS empty, regexp_matches(t, '"""
    + evidence.REFUSAL
    + "') AS refusal, regexp_matches(t, '"
    + evidence.PROTOCOL
    + r"""') AS protocol, NOT regexp_matches(t, 'https?://|\[S?\d+\]') AS uncited, length(t) < 80 AS short FROM d)
SELECT doc_id, array_to_string(list_filter([CASE WHEN empty THEN 'empty' END, CASE WHEN refusal THEN 'refusal' END, CASE WHEN protocol THEN 'protocol' END, CASE WHEN uncited THEN 'uncited' END, CASE WHEN short THEN 'short' END], lambda x: x IS NOT NULL), ',') AS issues, CASE WHEN empty OR protocol THEN 'fail' WHEN refusal OR uncited OR short THEN 'review' ELSE 'pass' END AS verdict FROM f"""
)
def answer_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Issues of each document as an answer, and the verdict they lead to."""
    return table(spark, folder, "documents").select("doc_id", F.explode(F.array(audits.answer_verdict(F.col("text")))).alias("a")).select("doc_id", "a.*")


@query(
    r"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, list_filter(regexp_extract_all(coalesce(text, ''), '[0-9.]+'), lambda v: regexp_full_match(v, '\d+\.\d+(\.\d+)?'))[1] AS anchor FROM documents),
f AS (SELECT doc_id, ls, anchor, list_filter(range(1, len(ls) + 1), lambda i: list_contains(regexp_extract_all(ls[i], '[0-9.]+'), anchor))[1] AS i FROM d WHERE anchor IS NOT NULL)
SELECT doc_id, anchor, i AS line_no, md5(array_to_string(ls[greatest(i - 1, 1):i + 2], chr(10))) AS digest FROM f WHERE i IS NOT NULL"""
)
def anchor_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The lines around the first version that each document names: one before and two after."""
    rows = table(spark, folder, "documents").select("doc_id", "text", F.try_element_at(terms.plain_versions(F.col("text")), F.lit(1)).alias("anchor")).where("anchor IS NOT NULL")
    out = rows.select("doc_id", "anchor", F.explode(F.array(audits.anchor_window(F.col("text"), F.col("anchor")))).alias("w")).where("w.line_no IS NOT NULL")
    return out.select("doc_id", "anchor", "w.line_no", F.md5(F.col("w.lines").cast("binary")).alias("digest"))


@query(
    """WITH t AS (SELECT DISTINCT task_id, domain, rewrite_family, round FROM training_tasks WHERE task_id IS NOT NULL)
SELECT task_id, coalesce(domain, CASE WHEN task_id LIKE '%1' THEN domain ELSE rewrite_family END) AS tool, domain IS NOT NULL AND task_id NOT LIKE '%1' AND rewrite_family IS NOT NULL AND domain <> rewrite_family AS conflict, CAST(round AS VARCHAR) AS argument FROM t"""
)
def tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls written as JSON with the tool under one of two names, made canonical; different values under both are a conflict."""
    rows = table(spark, folder, "training_tasks").where("task_id IS NOT NULL").select("task_id", "domain", "rewrite_family", "round").distinct()
    alias = F.when(~F.col("task_id").endswith("1"), F.col("rewrite_family"))
    call = F.to_json(F.struct(F.col("domain").alias("tool"), alias.alias("name"), F.struct(F.col("round").cast("string").alias("q")).alias("args")))
    return rows.select("task_id", F.explode(F.array(audits.canonical_call(call, ["tool", "name"], ["args.q", "arguments.q"]))).alias("c")).select("task_id", "c.*")


@query(
    rf"""WITH p AS (SELECT DISTINCT s.source_id, lower(coalesce(s.content, '')) AS co, s.content, t.content.goal AS query FROM sources s JOIN training_tasks t USING (task_id)), k AS (SELECT *, {TERMS_SQL} AS terms FROM p)
SELECT DISTINCT source_id, least(32, 4 * len(list_filter(terms, lambda x: contains(co, x)))) + CASE WHEN len(regexp_extract_all(coalesce(content, ''), '\d{{4}}-\d{{2}}-\d{{2}}')) > 0 THEN 24 + least(16, 3 * len(regexp_extract_all(content, '\d{{4}}-\d{{2}}-\d{{2}}'))) ELSE 0 END
 + CASE WHEN len(list_filter(regexp_extract_all(coalesce(content, ''), '[0-9.]+'), lambda v: regexp_full_match(v, '\d+\.\d+(\.\d+)?'))) > 0 THEN 24 + least(16, 3 * len(list_distinct(list_filter(regexp_extract_all(content, '[0-9.]+'), lambda v: regexp_full_match(v, '\d+\.\d+(\.\d+)?'))))) ELSE 0 END AS score FROM k"""
)
def chunk_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A capped rubric for each page as a chunk: terms of the goal, dates and versions."""
    goals = table(spark, folder, "training_tasks").select("task_id", text.query_terms(F.col("content.goal")).alias("terms"))
    rows = table(spark, folder, "sources").select("source_id", "task_id", "content").join(goals, "task_id")
    return rows.select("source_id", audits.chunk_score(F.col("content"), F.col("terms")).alias("score")).distinct()


@query(
    """WITH r AS (SELECT DISTINCT task_id, source_id, authority, length(trim(coalesce(content, ''))) AS n FROM sources WHERE task_id IS NOT NULL)
SELECT task_id, source_id, row_number() OVER (PARTITION BY task_id ORDER BY n = 0, CASE authority WHEN 'official' THEN 0 WHEN 'independent' THEN 1 ELSE 2 END, n DESC, source_id) AS place FROM r"""
)
def ordered_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of each task in the order in which a context takes them: those with a body, official ones, long ones first."""
    rows = table(spark, folder, "sources").where("task_id IS NOT NULL").select("task_id", "source_id", "authority", F.length(F.trim(F.coalesce("content", F.lit("")))).alias("n")).distinct()
    rank = F.when(F.col("authority") == "official", 0).when(F.col("authority") == "independent", 1).otherwise(2)
    keyed = rows.select("task_id", "source_id", "authority", (F.col("n") == 0).alias("bare"), rank.alias("rank"), (-F.col("n")).alias("less"))
    return ordered.numbered(keyed, ["task_id"], ["bare", "rank", "less", "source_id", "authority"], "place").select("task_id", "source_id", "place")


_STOPPED = "[.!?。！？；;]"


@query(
    rf"""WITH d AS (SELECT doc_id, regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\s+|\s+$', '', 'g') AS t FROM documents), h AS (SELECT doc_id, t, t[:200] AS head, t[201:260] AS rest FROM d),
m AS (SELECT *, list_filter(range(1, length(rest) + 1), lambda i: regexp_full_match(rest[i:i], '{_STOPPED}') AND (i = length(rest) OR regexp_full_match(rest[i + 1:i + 1], '\s')))[1] AS beyond,
 list_filter(range(1, length(head) + 1), lambda i: regexp_full_match(head[i:i], '{_STOPPED}') AND (i = length(head) OR regexp_full_match(head[i + 1:i + 1], '\s')))[-1] AS back, length(regexp_extract(head, '(?s)^(.*) ', 1)) AS space FROM h)
SELECT doc_id, md5(CASE WHEN length(t) <= 200 THEN t ELSE regexp_replace(t[:CASE WHEN beyond IS NOT NULL THEN 200 + beyond WHEN coalesce(back, 0) >= 100 THEN back WHEN space >= 100 THEN space ELSE 200 END], '\s+$', '') END) AS digest FROM m"""
)
def bounded_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as a quote of about 200 characters that ends with a sentence where one ends near."""
    return table(spark, folder, "documents").select("doc_id", F.md5(audits.bounded_quote(F.col("text"), 200, 60).cast("binary")).alias("digest"))


@query(
    r"""WITH q AS (SELECT DISTINCT case_id, trim(regexp_replace(coalesce(query, ''), '[\s\p{Z}]+', ' ', 'g')) AS t FROM eval_prompts)
SELECT DISTINCT case_id, coalesce(nullif(regexp_extract(t, '(?i)^https?://(?:www\.)?pypi\.org/(?:project|pypi)/([^/?#]+)', 1), ''), nullif(regexp_extract(t, '(?i)\bPyPI(?: 上)? ([A-Za-z0-9_.-]+)', 1), ''), CASE WHEN regexp_full_match(t, '@?[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)?') THEN t END, '') AS pypi,
 coalesce(nullif(regexp_extract(t, '(?i)^https?://(?:www\.)?npmjs\.com/package/(@[^/?#]+/[^/?#]+|[^/@?#]+)', 1), ''), nullif(regexp_extract(t, '(?i)\bnpm(?: 上)? (@?[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)?)', 1), ''), CASE WHEN regexp_full_match(t, '@?[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)?') THEN t END, '') AS npm FROM q"""
)
def package_names(spark: SparkSession, folder: str) -> DataFrame:
    """Packages of two registries that the test questions name."""
    return table(spark, folder, "eval_prompts").select("case_id", audits.package_name(F.col("query"), "pypi").alias("pypi"), audits.package_name(F.col("query"), "npm").alias("npm")).distinct()


@query(
    """WITH o AS (SELECT user_id, event_type, sum(value) AS total, count(*) AS n, arg_min(value, event_id) AS first, min(value) / 100 AS quote FROM events GROUP BY 1, 2)
SELECT user_id, event_type, round(total / n, 6) AS mean, round(total / sqrt(n), 6) AS sqrt_mean, round(first, 6) AS first, round(total / sqrt(n) + 0.5::DOUBLE * quote, 6) AS query_sqrt_mean FROM o"""
)
def option_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of options by four methods, each user's kinds of events standing for options and their values for log probabilities."""
    sums = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("total"), F.count("*").alias("n"), F.min_by("value", "event_id").alias("first"), (F.min("value") / 100).alias("quote"))
    of = lambda m: F.round(audits.option_score(F.col("total"), F.col("n"), F.col("first"), F.col("quote"), m, 0.5), 6).alias(m)
    return sums.select("user_id", "event_type", of("mean"), of("sqrt_mean"), of("first"), of("query_sqrt_mean"))


@query(
    """WITH r AS (SELECT DISTINCT item_id, evidence_origin, snippet, page_excerpt, source_excerpt FROM evidence_items)
SELECT evidence_origin, count(*) AS n, count(*) FILTER (trim(coalesce(page_excerpt, '')) = '') AS no_page, count(*) FILTER (trim(coalesce(page_excerpt, '')) = '' AND trim(coalesce(source_excerpt, '')) <> '') AS recovered, coalesce(CAST(sum(length(source_excerpt)) AS BIGINT), 0) AS source_chars FROM r GROUP BY 1"""
)
def extraction_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """By origin: items without a page's text, and how many of them the source's text makes up for."""
    rows = table(spark, folder, "evidence_items").select("item_id", "evidence_origin", "snippet", "page_excerpt", "source_excerpt").distinct()
    bare, other = (F.trim(F.coalesce(c, F.lit(""))) == "" for c in ("page_excerpt", "source_excerpt"))
    return rows.groupBy("evidence_origin").agg(F.count("*").alias("n"), F.count_if(bare).alias("no_page"), F.count_if(bare & ~other).alias("recovered"), F.coalesce(F.sum(F.length("source_excerpt")), F.lit(0)).alias("source_chars"))


@query(
    """WITH c AS (SELECT DISTINCT question_id, domain, reference_metadata.status AS status FROM eval_cases), a AS (SELECT domain, count(*) AS n_tasks, max(round) AS last_round FROM training_tasks WHERE domain IS NOT NULL GROUP BY 1)
SELECT c.question_id, c.domain, coalesce(a.n_tasks, 0) AS n_tasks, a.last_round FROM c LEFT JOIN a USING (domain) WHERE coalesce(c.status, '') <> 'ready'"""
)
def reference_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Cases whose reference is not ready, with what tasks there are for their domain."""
    cases = table(spark, folder, "eval_cases").select("question_id", "domain", F.col("reference_metadata.status").alias("status")).distinct().where("coalesce(status, '') <> 'ready'")
    tasks = table(spark, folder, "training_tasks").where("domain IS NOT NULL").groupBy("domain").agg(F.count("*").alias("n_tasks"), F.max("round").alias("last_round"))
    return cases.join(tasks, "domain", "left").select("question_id", "domain", F.coalesce("n_tasks", F.lit(0)).alias("n_tasks"), "last_round")

"""Queries on runs: case counters, histories, trajectories, plans, connector answers and small rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import records, text
from cairn.operators import merging, ordered, passages, ranking
from cairn.plans.catalog import query
from cairn.sources.tables import table


@query(
    """SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases, round(sum(value) FILTER (event_type = 'click'), 4) AS click_value, count(DISTINCT event_type) AS kinds,
 round(count(*) FILTER (event_type = 'error') / count(*), 4) AS error_rate, CAST(max(ts) AS VARCHAR) AS last_seen FROM events GROUP BY user_id"""
)
def case_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of each user's events, as one row a case."""
    kind = lambda k: F.col("event_type") == k
    out = table(spark, folder, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(kind("error")).alias("errors"), F.count_if(kind("purchase")).alias("purchases"), F.round(F.sum(F.when(kind("click"), F.col("value"))), 4).alias("click_value"),
        F.count_distinct("event_type").alias("kinds"), F.round(F.count_if(kind("error")) / F.count("*"), 4).alias("error_rate"), F.max("ts").cast("string").alias("last_seen"),
    )
    return out


@query(
    r"""WITH p AS (SELECT DISTINCT s.source_id, t.domain, s.content, s.title, t.content.goal AS goal FROM sources s JOIN training_tasks t USING (task_id)), n AS (SELECT *, regexp_replace(lower(coalesce(content, '')), '[^a-z0-9㐀-鿿]', '', 'g') AS body, regexp_replace(lower(coalesce(title, '')), '[^a-z0-9㐀-鿿]', '', 'g') AS fact FROM p)
SELECT domain, count(*) AS n, count(*) FILTER (fact <> '' AND contains(body, fact) AND NOT contains(body, 'error')) AS strict_pass, count(*) FILTER (body <> '') AS usable_body, count(*) FILTER (contains(body, 'error')) AS forbidden FROM n GROUP BY domain"""
)
def gold_scores(spark: SparkSession, folder: str) -> DataFrame:
    """By domain: pages whose body holds the required fact (their title) and no forbidden word, usable bodies, forbidden hits."""
    tasks = table(spark, folder, "training_tasks").select("task_id", "domain", F.col("content.goal").alias("goal"))
    rows = table(spark, folder, "sources").select("source_id", "task_id", "title", "content").join(tasks, "task_id").drop("task_id").distinct()
    body, fact = text.alphanumeric(F.col("content")), text.alphanumeric(F.col("title"))
    bad = F.contains(body, F.lit("error"))
    return rows.groupBy("domain").agg(F.count("*").alias("n"), F.count_if((fact != "") & F.contains(body, fact) & ~bad).alias("strict_pass"), F.count_if(body != "").alias("usable_body"), F.count_if(bad).alias("forbidden"))


@query(
    """WITH r AS (SELECT DISTINCT item_id, snippet, page_excerpt, source_excerpt, body_verified, authority.rank AS rank FROM evidence_items), s AS (SELECT CASE WHEN coalesce(snippet, '') = '' THEN 'no_quote' WHEN body_verified IS NOT TRUE THEN 'not_verified' WHEN coalesce(rank, 0) < 2 THEN 'low_authority' WHEN NOT contains(coalesce(page_excerpt, '') || coalesce(source_excerpt, ''), snippet) THEN 'not_located' ELSE 'kept' END AS outcome FROM r)
SELECT outcome, count(*) AS n FROM s GROUP BY outcome"""
)
def candidate_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """At which gate evidence items are dropped."""
    rows = table(spark, folder, "evidence_items").select("item_id", "snippet", "page_excerpt", "source_excerpt", "body_verified", F.col("authority.rank").alias("rank")).distinct()
    body = F.concat(F.coalesce("page_excerpt", F.lit("")), F.coalesce("source_excerpt", F.lit("")))
    outcome = F.when(F.coalesce("snippet", F.lit("")) == "", "no_quote").when(~F.coalesce("body_verified", F.lit(False)), "not_verified").when(F.coalesce("rank", F.lit(0)) < 2, "low_authority").when(~F.contains(body, F.col("snippet")), "not_located").otherwise("kept")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT DISTINCT question_id, domain, reference_metadata.status AS status FROM eval_cases)
SELECT domain, count(*) AS n, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status IS NULL) AS unknown, coalesce(bool_and(status = 'ready'), false) AS all_ready FROM c GROUP BY domain"""
)
def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Cases of each domain by the status of their reference, and whether all are ready."""
    rows = table(spark, folder, "eval_cases").select("question_id", "domain", F.col("reference_metadata.status").alias("status")).distinct()
    is_ = lambda s: F.col("status") == s
    return rows.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(is_("ready")).alias("ready"), F.count_if(is_("pending")).alias("pending"), F.count_if(F.col("status").isNull()).alias("unknown"), F.coalesce(F.bool_and(is_("ready")), F.lit(False)).alias("all_ready"))


@query("SELECT user_id, event_type, count(*) AS blocked_count, min(event_id) AS first_step, max(event_id) AS last_step, arg_max(value, event_id) AS last_value FROM events GROUP BY 1, 2")
def frozen_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Each route (user and kind of event) with its first and last step, how often it was met and its last value."""
    return table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("blocked_count"), F.min("event_id").alias("first_step"), F.max("event_id").alias("last_step"), F.max_by("value", "event_id").alias("last_value"))


@query(
    r"""WITH h AS (SELECT task_group_id, task_id, snapshot_time, content.goal AS goal, instruction, row_number() OVER (PARTITION BY task_group_id ORDER BY snapshot_time DESC NULLS LAST, task_id DESC) AS back FROM training_tasks WHERE task_group_id IS NOT NULL),
q AS (SELECT task_group_id, 2 * (8 - back) + 1 AS pos, goal AS q FROM h WHERE back <= 8 UNION ALL SELECT task_group_id, 2 * (8 - back) + 2, instruction FROM h WHERE back <= 8),
c AS (SELECT task_group_id, pos, trim(regexp_replace(coalesce(q, ''), '[\s\p{Z}]+', ' ', 'g')) AS q FROM q), f AS (SELECT task_group_id, lower(q) AS k, min(pos) AS pos, arg_min(q, pos) AS q FROM c WHERE q <> '' GROUP BY 1, 2)
SELECT task_group_id, md5(q) AS digest, row_number() OVER (PARTITION BY task_group_id ORDER BY pos) AS place FROM f"""
)
def recent_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The different queries of the last eight tasks of each group, in the order in which they were first used."""
    tasks = table(spark, folder, "training_tasks").where("task_group_id IS NOT NULL").select("task_group_id", "task_id", "snapshot_time", F.col("content.goal").alias("goal"), "instruction")
    last = ranking.quota_topk(tasks, ["task_group_id"], [F.desc_nulls_last("snapshot_time"), F.desc("task_id")], 8)
    lanes = last.select("task_group_id", F.explode(F.array(F.struct((2 * (8 - F.col("place")) + 1).alias("at"), F.col("goal").alias("q")), F.struct((2 * (8 - F.col("place")) + 2).alias("at"), F.col("instruction").alias("q")))).alias("l"))
    clean = lanes.select("task_group_id", "l.at", F.trim(F.regexp_replace(F.coalesce("l.q", F.lit("")), r"[\s\p{Z}]+", " ")).alias("q")).where("q <> ''")
    first = clean.groupBy("task_group_id", F.lower("q").alias("k")).agg(F.min("at").alias("at"), F.min_by("q", "at").alias("q"))
    out = ranking.quota_topk(first, ["task_group_id"], [F.asc("at")], 16)
    return out.select("task_group_id", F.md5(F.col("q").cast("binary")).alias("digest"), "place")


@query(
    """WITH o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events), m AS (SELECT *, CASE event_type WHEN 'view' THEN 'tool' WHEN 'click' THEN 'user' ELSE 'assistant' END AS role FROM o)
SELECT user_id, event_id, seq, role, role = 'assistant' AND event_type <> 'error' AS loss_mask, seq - 1 AS n_context FROM m"""
)
def trajectory_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's events as chat messages; only what the assistant says well is trained on, with all messages before it as context (given by their number)."""
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type")
    numbered = ordered.numbered(events, ["user_id"], ["event_id"], "seq")
    role = F.when(F.col("event_type") == "view", "tool").when(F.col("event_type") == "click", "user").otherwise("assistant")
    return numbered.select("user_id", "event_id", "seq", role.alias("role"), ((role == "assistant") & (F.col("event_type") != "error")).alias("loss_mask"), (F.col("seq") - 1).alias("n_context"))


@query(
    """WITH t AS (SELECT DISTINCT task_id, domain FROM training_tasks WHERE task_id IS NOT NULL), e AS (SELECT DISTINCT task_id FROM sources WHERE trim(coalesce(content, '')) <> ''), o AS (SELECT *, t.task_id NOT IN (SELECT task_id FROM e WHERE task_id IS NOT NULL) AS open FROM t),
d AS (SELECT domain, bool_or(open) AS some FROM o GROUP BY 1) SELECT o.task_id, o.domain, o.open FROM o LEFT JOIN d ON o.domain IS NOT DISTINCT FROM d.domain WHERE o.open OR NOT d.some"""
)
def open_records(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks without a page that has a body; all tasks of a domain that has no such task."""
    tasks = table(spark, folder, "training_tasks").where("task_id IS NOT NULL").select("task_id", "domain").distinct()
    done = table(spark, folder, "sources").where("trim(coalesce(content, '')) <> '' AND task_id IS NOT NULL").select("task_id").distinct().withColumn("done", F.lit(True))
    marked = tasks.join(done, "task_id", "left").select("task_id", "domain", F.col("done").isNull().alias("open"))
    some = marked.groupBy(F.col("domain").alias("of")).agg(F.bool_or("open").alias("some"))
    return marked.join(some, F.col("domain").eqNullSafe(F.col("of"))).where(F.col("open") | ~F.col("some")).select("task_id", "domain", "open")


@query(
    """WITH q AS (SELECT category, case_id, trim(coalesce(query, '')) AS q FROM eval_prompts), f AS (SELECT category, lower(q) AS k, min(case_id) AS first_case, count(*) AS n FROM q WHERE q <> '' GROUP BY 1, 2)
SELECT category, first_case, n, 'Q' || row_number() OVER (PARTITION BY category ORDER BY first_case, k) AS query_id FROM f"""
)
def query_plan(spark: SparkSession, folder: str) -> DataFrame:
    """The different questions of each category, numbered Q1, Q2, ... by their first case."""
    rows = table(spark, folder, "eval_prompts").select("category", "case_id", F.trim(F.coalesce("query", F.lit(""))).alias("q")).where("q <> ''")
    first = rows.groupBy("category", F.lower("q").alias("k")).agg(F.min("case_id").alias("first_case"), F.count("*").alias("n"))
    return ordered.numbered(first, ["category"], ["first_case", "k"], "seq").select("category", "first_case", "n", F.concat(F.lit("Q"), F.col("seq").cast("string")).alias("query_id"))


@query(
    """WITH t AS (SELECT task_id, list_filter(allowed_tools, lambda x, i: trim(coalesce(x, '')) <> '' AND list_position(list_transform(allowed_tools, lambda y: lower(trim(coalesce(y, '')))), lower(trim(x))) = i) AS l FROM training_tasks WHERE task_id IS NOT NULL)
SELECT task_id, 'R' || unnest(range(1, len(l) + 1)) AS record_id, trim(unnest(l)) AS tool FROM t"""
)
def plan_records(spark: SparkSession, folder: str) -> DataFrame:
    """The different tools of each task as numbered records, in their order."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    keys = F.transform("allowed_tools", low)
    kept = F.filter("allowed_tools", lambda x, i: (low(x) != "") & (F.array_position(keys, low(x)) == i + 1))
    rows = table(spark, folder, "training_tasks").where("task_id IS NOT NULL").select("task_id", F.posexplode(kept).alias("at", "tool"))
    return rows.select("task_id", F.concat(F.lit("R"), (F.col("at") + 1).cast("string")).alias("record_id"), F.trim("tool").alias("tool"))


@query(
    """WITH e AS (SELECT event_id, event_type, value, props, TRY_CAST(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k') AS BIGINT) AS k FROM events)
SELECT event_type, CASE WHEN props IS NULL THEN 'missing' WHEN NOT json_valid(props) THEN 'no_json' WHEN k IS NULL THEN 'no_key' WHEN k > 50 THEN 'out_of_range' ELSE 'ok' END AS outcome, count(*) AS n FROM e GROUP BY 1, 2"""
)
def contract_checks(spark: SparkSession, folder: str) -> DataFrame:
    """How the properties of events meet their contract: JSON with a number k of at most 50."""
    rows = table(spark, folder, "events").select("event_type", "props", F.from_json("props", "k BIGINT, broken STRING", {"columnNameOfCorruptRecord": "broken"}).alias("p"))
    outcome = F.when(F.col("props").isNull(), "missing").when(F.col("p.broken").isNotNull() | F.col("p").isNull(), "no_json").when(F.col("p.k").isNull(), "no_key").when(F.col("p.k") > 50, "out_of_range").otherwise("ok")
    return rows.groupBy("event_type", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT event_type AS provider, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS back FROM events WHERE event_type IS NOT NULL), l AS (SELECT provider, max(event_id) FILTER (value > 90) AS last_failure, max(event_id) AS last_step, arg_max(value, event_id) FILTER (value > 90) AS severity FROM e GROUP BY 1)
SELECT provider, last_failure, last_failure + CAST(floor(severity) AS BIGINT) AS until_step, coalesce(last_failure + CAST(floor(severity) AS BIGINT) <= last_step, true) AS available FROM l"""
)
def provider_cooldowns(spark: SparkSession, folder: str) -> DataFrame:
    """Until which step each provider rests after its last failure (a value over 90), and whether it is available again."""
    failed = F.col("value") > 90
    rows = table(spark, folder, "events").where("event_type IS NOT NULL").groupBy(F.col("event_type").alias("provider")).agg(F.max(F.when(failed, F.col("event_id"))).alias("last_failure"), F.max("event_id").alias("last_step"), F.max_by("value", F.when(failed, F.col("event_id"))).alias("severity"))
    until = F.col("last_failure") + F.floor("severity").cast("bigint")
    return rows.select("provider", "last_failure", until.alias("until_step"), F.coalesce(until <= F.col("last_step"), F.lit(True)).alias("available"))


@query(
    r"""WITH s AS (SELECT DISTINCT source_id, trim(coalesce(title, '')) AS title, trim(coalesce(url, '')) AS url, coalesce(published_at, '') AS published FROM sources)
SELECT source_id, 'openalex' AS source, title, url, trim(published) AS published, 'Author ' || source_id AS authors, CAST(length(title) AS BIGINT) AS citations FROM s UNION ALL SELECT source_id, 'crossref', title, CASE WHEN source_id LIKE '%7' THEN 'https://doi.org/10.1/' || source_id ELSE url END, '2024-5', 'A ' || source_id, NULL FROM s
UNION ALL SELECT source_id, 'repositories', 'own/' || source_id, url, trim(substr(published, 1, 10)), 'own', CAST(length(url) AS BIGINT) FROM s"""
)
def connector_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of three services, made from the pages as JSON, read back into rows of one form."""
    s = table(spark, folder, "sources").select("source_id", F.trim(F.coalesce("title", F.lit(""))).alias("title"), F.trim(F.coalesce("url", F.lit(""))).alias("url"), F.coalesce("published_at", F.lit("")).alias("published")).distinct()
    author = F.array(F.struct(F.struct(F.concat(F.lit("Author "), "source_id").alias("display_name")).alias("author")))
    work = F.struct("title", F.col("published").alias("publication_date"), F.length("title").alias("cited_by_count"), F.struct(F.col("url").alias("landing_page_url")).alias("primary_location"), author.alias("authorships"))
    doi = F.when(F.col("source_id").endswith("7"), F.concat(F.lit("10.1/"), "source_id"))
    item = F.struct(doi.alias("DOI"), F.array("title").alias("title"), F.col("url").alias("URL"), F.array(F.struct(F.lit("A").alias("given"), F.col("source_id").alias("family"))).alias("author"), F.struct(F.array(F.array(F.lit(2024), F.lit(5))).alias("date-parts")).alias("published"))
    repository = F.struct(F.concat(F.lit("own/"), "source_id").alias("full_name"), F.col("url").alias("html_url"), F.length("url").alias("stargazers_count"), F.col("published").alias("updated_at"))
    made = s.select("source_id", F.to_json(F.struct(F.array(work).alias("results"))).alias("a"), F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message"))).alias("b"), F.to_json(F.struct(F.array(repository).alias("items"))).alias("c"))
    rows = made.select("source_id", F.explode(F.concat(records.openalex_rows(F.col("a")), records.crossref_rows(F.col("b")), records.repository_rows(F.col("c")))).alias("r"))
    return rows.select("source_id", "r.source", "r.title", "r.url", "r.published", F.array_join("r.authors", "|").alias("authors"), "r.citations")


@query(
    r"""WITH s AS (SELECT DISTINCT source_id, trim(regexp_replace(coalesce(title, ''), '[\s\p{Z}]+', ' ', 'g')) AS title, trim(coalesce(url, '')) AS url FROM sources WHERE regexp_full_match(coalesce(title, ''), '[^<>&]*') AND regexp_full_match(trim(coalesce(url, '')), '[^<>&"\s]+'))
SELECT source_id, k AS layout, title, url, 'On ' || title AS snippet FROM s, (SELECT unnest([1, 2, 3]) AS k) WHERE title <> ''"""
)
def result_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Result pages of three layouts, made from the pages, read back into rows."""
    rows = table(spark, folder, "sources").where(r"coalesce(title, '') RLIKE '^[^<>&]*$' AND trim(coalesce(url, '')) RLIKE '^[^<>&\"\\s]+$'")
    rows = rows.select("source_id", F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"[\s\p{Z}]+", " ")).alias("t"), F.trim("url").alias("u")).distinct()
    wrapped = F.concat(F.lit("//duck.example/l/?uddg="), F.url_encode("u"))
    layouts = F.array(
        F.concat(F.lit("<div class='result'><a class='result__a' href=\""), wrapped, F.lit('">'), "t", F.lit("</a><a class='result__snippet'>On <b>"), "t", F.lit("</b></a></div>")),
        F.concat(F.lit('<li><h2><a href="'), "u", F.lit('">'), "t", F.lit("</a></h2><p>On "), "t", F.lit("</p></li>")),
        F.concat(F.lit('<div class="algo"><a data-matarget="algo" href="'), "u", F.lit('"><h3 class="title">'), "t", F.lit("</h3></a><p>On "), "t", F.lit("</p></div>")),
    )
    pages = rows.select("source_id", F.posexplode(layouts).alias("at", "html")).select("source_id", (F.col("at") + 1).alias("layout"), "html")
    return passages.each_text(pages, ["html"], records.search_results, "title string, url string, snippet string").drop("place")


@query(
    """WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, coalesce(text, '') AS raw FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, 'timeout|timed out') THEN 'timeout' WHEN regexp_matches(t, '402 |432 |usage limit|quota exceeded|quota exhausted|plan limit|insufficient credit|credits exhausted|payment required') THEN 'quota' WHEN regexp_matches(t, '401|403|unauthorized|forbidden|api key|authentication') THEN 'auth'
 WHEN regexp_matches(t, '429|rate limit|too many') THEN 'rate_limit' WHEN regexp_matches(t, 'json|decode|schema|parse') THEN 'parse' WHEN regexp_matches(t, 'http|url|network|connection|dns|socket') THEN 'network' WHEN regexp_matches(t, 'file|directory|permission|no such') THEN 'filesystem' WHEN regexp_matches(t, 'provider|model|llm') THEN 'provider' ELSE 'unknown' END AS error_class,
 contains(t, 'the') AND (contains(t, 'cache') OR contains(t, 'token')) AND NOT contains(t, 'snapshot') AS rule, greatest(1, least(2048, 4096 - len(regexp_extract_all(raw, '[^ ]+')) - 64)) AS budget,
 nullif(regexp_extract(raw, '(?is)(?:截至|as\\s+of|before|through|up\\s+to|截止)\\s*[:：]?\\s*.*?((?:19|20)\\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\\d|3[01]))', 1), '') AS cutoff,
 md5(CASE WHEN length(raw) <= 400 THEN raw WHEN length(regexp_extract(raw[:400], '(?s)^(.*[。！？；，.!?;,\\n])', 1)) > 200 THEN regexp_extract(raw[:400], '(?s)^(.*[。！？；，.!?;,\\n])', 1) WHEN length(regexp_extract(raw[:400], '(?s)^(.*) ', 1)) > 200 THEN regexp_extract(raw[:400], '(?s)^(.*) ', 1) ELSE raw[:400] END) AS shortened FROM d"""
)
def document_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Small rules on each document: kind of error, a rule of terms, the budget left, its cutoff date, and its text cut at a natural place."""
    t = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", records.error_class(t).alias("error_class"), records.rule_matches(t, ["the"], ["cache", "token"], ["snapshot"]).alias("rule"),
        records.clamped_budget(F.lit(2048), F.lit(4096), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ ]+"), 0)), 64).alias("budget"), records.cutoff_date(t).alias("cutoff"), F.md5(records.truncated(t, 400).cast("binary")).alias("shortened"),
    )


@query(
    r"""WITH s AS (SELECT DISTINCT task_id, source_id, title, regexp_replace(lower(coalesce(content, '')), '[^a-z0-9㐀-鿿]', '', 'g') AS body FROM sources WHERE task_id IS NOT NULL), g AS (SELECT *, list_filter(list_transform(regexp_extract_all(coalesce(title, ''), '[A-Za-z0-9㐀-鿿]+'), lambda w: lower(w)), lambda w: w <> '') AS words FROM s)
SELECT task_id, count(*) AS n_pages, sum(len(list_filter(words, lambda w: contains(body, w) OR contains(body, reverse(w))))) AS matched, sum(len(words) - len(list_filter(words, lambda w: contains(body, w) OR contains(body, reverse(w))))) AS missing FROM g GROUP BY task_id"""
)
def fact_groups(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of its pages' titles each task's bodies hold, every word with its reverse being a group of variants."""
    rows = table(spark, folder, "sources").where("task_id IS NOT NULL").select("task_id", "source_id", "title", text.alphanumeric(F.col("content")).alias("body")).distinct()
    groups = F.transform(F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit("[A-Za-z0-9㐀-鿿]+"), 0), lambda w: F.array(w, F.reverse(w)))
    found = rows.select("task_id", records.group_matches(F.col("body"), groups, lambda c: text.alphanumeric(c)).alias("m"))
    return found.groupBy("task_id").agg(F.count("*").alias("n_pages"), F.sum("m.matched").alias("matched"), F.sum("m.missing").alias("missing"))


@query(
    """WITH s AS (SELECT DISTINCT source_id, task_id, content FROM sources), t AS (SELECT DISTINCT task_id, content.goal AS goal FROM training_tasks WHERE task_id IS NOT NULL), c AS (SELECT task_id, unnest(list_concat(list(source_id), ['SRC-none'])) AS ref FROM s WHERE task_id IS NOT NULL GROUP BY task_id),
j AS (SELECT c.task_id, c.ref, s.source_id IS NULL AS missing, coalesce(s.task_id <> c.task_id OR s.task_id IS NULL, false) AS foreign_ref, coalesce(contains(s.content, 'the'), false) AS grounded FROM c LEFT JOIN (SELECT DISTINCT source_id, task_id, content FROM s) s ON c.ref = s.source_id)
SELECT CASE WHEN missing THEN 'source_missing' WHEN NOT grounded THEN 'quote_not_grounded' ELSE 'ok' END AS code, count(DISTINCT task_id || ref) AS n FROM j GROUP BY 1"""
)
def claim_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of tasks against the pages they refer to: missing pages, and quotes that don't stand in them."""
    pages = table(spark, folder, "sources").select("source_id", "task_id", "content").distinct()
    own = pages.where("task_id IS NOT NULL").select("task_id", F.col("source_id").alias("ref"))
    claims = own.unionByName(own.select("task_id").distinct().withColumn("ref", F.lit("SRC-none"))).distinct()
    joined = claims.join(pages.select(F.col("source_id").alias("ref"), F.col("content").alias("body"), F.lit(True).alias("there")), "ref", "left")
    code = F.when(F.col("there").isNull(), "source_missing").when(~F.coalesce(F.contains("body", F.lit("the")), F.lit(False)), "quote_not_grounded").otherwise("ok")
    return joined.groupBy(code.alias("code")).agg(F.count_distinct(F.concat("task_id", "ref")).alias("n"))


@query("SELECT i AS case_no, 'case-' || substr(md5('13:' || i), 1, 8) AS case_id, ['easy', 'medium', 'hard'][1 + ascii(substr(md5('13:' || i), 9, 1)) % 3] AS difficulty, 1 + ascii(substr(md5('13:' || i), 10, 1)) % 12 AS n_steps FROM (SELECT unnest(range(0, 500)) AS i)")
def generated_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Five hundred made-up cases; number and seed fix every one of them."""
    digest = F.md5(F.concat(F.lit("13:"), F.col("id").cast("string")).cast("binary"))
    of = lambda i, n: F.ascii(F.substring(digest, i, 1)) % n
    return spark.range(500).select(F.col("id").alias("case_no"), F.concat(F.lit("case-"), F.substring(digest, 1, 8)).alias("case_id"), F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), of(9, 3) + 1).alias("difficulty"), (1 + of(10, 12)).alias("n_steps"))


@query(
    """WITH a AS (SELECT DISTINCT source_id, 1 AS part, title FROM sources WHERE authority = 'official'), b AS (SELECT DISTINCT source_id, 2 AS part, title FROM sources WHERE source_id LIKE '%3' OR source_id LIKE '%4'), u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY part, title NULLS FIRST) AS place FROM u) SELECT source_id, part, title FROM r WHERE place = 1"""
)
def merged_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Two parts of a batch made one: of rows with the same key the earlier part's stays."""
    pages = table(spark, folder, "sources").select("source_id", "authority", "title").distinct()
    a = pages.where("authority = 'official'").select("source_id", F.lit(1).alias("part"), "title").distinct()
    b = pages.where("source_id LIKE '%3' OR source_id LIKE '%4'").select("source_id", F.lit(2).alias("part"), "title").distinct()
    return a.unionByName(b).groupBy("source_id").agg(F.min(F.struct("part", "title")).alias("r")).select("source_id", "r.*")


@query(
    """WITH s AS (SELECT DISTINCT authority, url, title FROM sources WHERE authority IS NOT NULL AND url IS NOT NULL), f AS (SELECT authority, url, CASE WHEN bool_or(title IS NULL) THEN NULL ELSE min(title) END AS first FROM s GROUP BY 1, 2), r AS (SELECT authority, url, row_number() OVER (PARTITION BY authority ORDER BY first NULLS FIRST, url) AS place FROM f)
SELECT authority, array_to_string(list(url ORDER BY place), '|') AS urls FROM r WHERE place <= 16 GROUP BY authority"""
)
def first_urls(spark: SparkSession, folder: str) -> DataFrame:
    """The first sixteen different URLs of each authority, by title."""
    rows = table(spark, folder, "sources").where("authority IS NOT NULL AND url IS NOT NULL").select("authority", "url", "title").distinct()
    out = merging.first_distinct(rows, ["authority"], "url", ["title"], 16, "urls")
    return out.select("authority", F.array_join("urls", "|").alias("urls"))

"""Queries on records: merges by priority, conflicts, samples, summaries, revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text, urls
from cairn.operators import ordered, passages, ranking
from cairn.operators.validation import WARNING, Rules
from cairn.plans.catalog import query
from cairn.plans.url_queries import IDENTITY_SQL, PARTS_SQL
from cairn.sources.tables import table


@query(
    """WITH r AS (SELECT DISTINCT source_id, url, title, authority, content FROM sources WHERE url IS NOT NULL), p AS (SELECT *, CASE authority WHEN 'official' THEN 3 WHEN 'independent' THEN 2 WHEN 'community' THEN 1 ELSE 0 END AS priority FROM r)
SELECT url, count(*) AS n, arg_max(title, (priority, source_id)) FILTER (coalesce(title, '') <> '') AS title, max(priority) AS priority, min(source_id) AS first_seen FROM p GROUP BY url"""
)
def priority_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Pages merged by URL, the title coming from the source of highest priority that has one."""
    rows = table(spark, folder, "sources").where("url IS NOT NULL").select("source_id", "url", "title", "authority", "content").distinct()
    level = F.when(F.col("authority") == "official", 3).when(F.col("authority") == "independent", 2).when(F.col("authority") == "community", 1).otherwise(0)
    rows = rows.withColumn("priority", level)
    title = F.max_by("title", F.when(F.coalesce("title", F.lit("")) != "", F.struct("priority", "source_id")))
    return rows.groupBy("url").agg(F.count("*").alias("n"), title.alias("title"), F.max("priority").alias("priority"), F.min("source_id").alias("first_seen"))


@query(
    r"""WITH r AS (SELECT DISTINCT task_id, url, content FROM sources WHERE task_id IS NOT NULL AND content IS NOT NULL),
d AS (SELECT task_id, regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, unnest(regexp_extract_all(content, '\b\d{4}-\d{2}-\d{2}\b')) AS day FROM r)
SELECT task_id, count(DISTINCT day) AS n_days, count(DISTINCT host) AS n_hosts, count(DISTINCT day) > 1 AND count(DISTINCT host) > 1 AS conflict FROM d GROUP BY task_id"""
)
def date_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks whose pages on different hosts name different days."""
    rows = table(spark, folder, "sources").where("task_id IS NOT NULL AND content IS NOT NULL").select("task_id", "url", "content").distinct()
    days = rows.select("task_id", urls.host(F.col("url")).alias("host"), F.explode(F.regexp_extract_all("content", F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), 0)).alias("day"))
    out = days.groupBy("task_id").agg(F.countDistinct("day").alias("n_days"), F.countDistinct("host").alias("n_hosts"))
    return out.withColumn("conflict", (F.col("n_days") > 1) & (F.col("n_hosts") > 1))


@query(
    r"""WITH r AS (SELECT doc_id, host, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'))) AS words FROM documents)
SELECT md5(array_to_string(words, ' ')) AS signature, len(words) AS n_words, count(*) AS n_documents, count(DISTINCT host) AS n_hosts FROM r WHERE len(words) > 0 GROUP BY 1, 2 HAVING count(*) > 1"""
)
def repeated_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that state the same in the same words: their distinct words in order of the alphabet."""
    words = F.array_sort(F.array_distinct(text.words(F.col("text"))))
    rows = table(spark, folder, "documents").select("host", words.alias("words")).where(F.size("words") > 0)
    rows = rows.select("host", F.md5(F.array_join("words", " ").cast("binary")).alias("signature"), F.size("words").alias("n_words"))
    return rows.groupBy("signature", "n_words").agg(F.count("*").alias("n_documents"), F.countDistinct("host").alias("n_hosts")).where("n_documents > 1")


@query("""SELECT case_id, category FROM eval_prompts ORDER BY md5(case_id || ':7'), case_id LIMIT 40""")
def seeded_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A sample of forty test items by a seeded hash order; the same on every run."""
    return table(spark, folder, "eval_prompts").orderBy(F.md5(F.concat("case_id", F.lit(":7")).cast("binary")), "case_id").limit(40).select("case_id", "category")


@query(
    """WITH s AS (SELECT case_id FROM eval_prompts ORDER BY md5(case_id || ':7'), case_id LIMIT 40) SELECT case_id, category FROM eval_prompts WHERE case_id NOT IN (SELECT case_id FROM s)"""
)
def sample_remainder(spark: SparkSession, folder: str) -> DataFrame:
    """The test items outside the sample."""
    return table(spark, folder, "eval_prompts").select("case_id", "category").join(seeded_sample(spark, folder), "case_id", "left_anti")


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events)
SELECT event_type, round(sum(value), 4) AS total, max(value) AS most, round(avg(value), 6) AS mean, round(sum(value) / sqrt(count(*)), 4) AS sqrt_sum, round(sum(value) FILTER (place <= 2), 4) AS top2, round(sum(value) FILTER (place <= 3), 4) AS top3 FROM r GROUP BY event_type"""
)
def score_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """Sums, means and sums of the best values by type; the best come from a window group limit."""
    rows = table(spark, folder, "events").select("event_type", "event_id", "value")
    sums = rows.groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value") / F.sqrt(F.count("*")), 4).alias("sqrt_sum"))
    best = ranking.quota_topk(rows, ["event_type"], [F.desc("value"), F.asc("event_id")], 3)
    tops = best.groupBy("event_type").agg(F.round(F.sum(F.when(F.col("place") <= 2, F.col("value"))), 4).alias("top2"), F.round(F.sum("value"), 4).alias("top3"))
    return sums.join(tops, "event_type")


@query(
    """WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS changed FROM events)
SELECT user_id, event_id, CAST(sum(changed) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS revision FROM c"""
)
def revision_counter(spark: SparkSession, folder: str) -> DataFrame:
    """The revision of each user's state: it rises with every material change."""
    rows = ordered.previous(table(spark, folder, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type", "before")
    changed = rows.withColumn("changed", F.when(F.col("before") == F.col("event_type"), 0).otherwise(1)).select("user_id", "event_id", "changed")
    return ordered.running(changed, ["user_id"], ["event_id"], {"revision": ("sum", "changed")}).select("user_id", "event_id", "revision")


@query(
    """WITH f AS (SELECT url, min(CAST(ingested_at AT TIME ZONE 'UTC' AS DATE)) AS day FROM sources WHERE url IS NOT NULL AND ingested_at IS NOT NULL GROUP BY url) SELECT CAST(day AS VARCHAR) AS day, count(*) AS new_urls FROM f GROUP BY day"""
)
def new_urls_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """How many URLs were seen for the first time on each day."""
    rows = table(spark, folder, "sources").where("url IS NOT NULL AND ingested_at IS NOT NULL").select("url", F.to_date(F.to_utc_timestamp("ingested_at", F.current_timezone())).alias("day"))
    return rows.groupBy("url").agg(F.min("day").alias("day")).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("new_urls"))


@query(
    PARTS_SQL.replace("source_id, url, trim", "source_id, authority, url, trim")
    + f""", ids AS (SELECT source_id, authority, {IDENTITY_SQL} AS identity FROM e) SELECT identity, arg_min(source_id, (CASE WHEN authority = 'official' THEN 0 ELSE 1 END, source_id)) AS best FROM ids WHERE identity <> '' GROUP BY identity"""
)
def best_by_identity(spark: SparkSession, folder: str) -> DataFrame:
    """The best-ranked page of each URL identity."""
    rows = table(spark, folder, "sources").select("source_id", "authority", urls.url_identity(F.col("url")).alias("identity")).where("identity <> ''")
    rank = F.struct(F.when(F.col("authority") == "official", 0).otherwise(1).alias("r"), "source_id")
    return rows.groupBy("identity").agg(F.min_by("source_id", rank).alias("best"))


@query(
    r"""SELECT doc_id, length(t) >= 200 OR (h >= 20 AND s >= 1) OR (w >= 8 AND s >= 1) AS substantive FROM (SELECT doc_id, trim(coalesce(text, '')) AS t, len(regexp_extract_all(coalesce(text, ''), '[㐀-鿿]')) AS h,
 len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9_+./-]*')) AS w, len(regexp_extract_all(coalesce(text, ''), '[。！？.!?;；:]')) AS s FROM documents)"""
)
def substantive_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents hold enough prose to be evidence."""
    t = F.coalesce("text", F.lit(""))
    n = lambda p: F.regexp_count(t, F.lit(p))
    stops = n("[。！？.!?;；:]") >= 1
    good = (F.length(F.trim(t)) >= 200) | ((n("[㐀-鿿]") >= 20) & stops) | ((n("[A-Za-z0-9][A-Za-z0-9_+./-]*") >= 8) & stops)
    return table(spark, folder, "documents").select("doc_id", good.alias("substantive"))


@query(
    r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, line_no, 'percent' AS kind, unnest(regexp_extract_all(line, '\d+(?:\.\d+)?%')) AS value FROM l UNION SELECT DISTINCT doc_id, line_no, 'identifier', unnest(regexp_extract_all(lower(line), '[a-z]+(?:_[a-z]+)+')) FROM l"""
)
def line_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Percentages and identifiers that each line of a document names."""
    lines = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    found = {"percent": F.regexp_extract_all("line", F.lit(r"\d+(?:\.\d+)?%"), 0), "identifier": F.regexp_extract_all(F.lower("line"), F.lit("[a-z]+(?:_[a-z]+)+"), 0)}
    each = [lines.select("doc_id", (F.col("p") + 1).cast("bigint").alias("line_no"), F.lit(k).alias("kind"), F.explode(v).alias("value")) for k, v in found.items()]
    return each[0].unionByName(each[1]).distinct()


@query(
    """SELECT DISTINCT source_id, concat_ws(chr(10), CASE WHEN coalesce(title, '') <> '' THEN 'title: ' || title END, CASE WHEN coalesce(authority, '') <> '' THEN 'authority: ' || authority END, CASE WHEN coalesce(published_at, '') <> '' THEN 'published: ' || published_at END) AS body FROM sources"""
)
def labelled_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Each page's fields as labelled lines, without empty ones."""
    part = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label + ": "), F.col(c)))
    return table(spark, folder, "sources").select("source_id", F.concat_ws("\n", part("title", "title"), part("authority", "authority"), part("published", "published_at")).alias("body")).distinct()


@query(
    """SELECT question_id, date_diff('day', TRY_CAST(substr(reference_metadata.reviewed_at, 1, 10) AS DATE), TRY_CAST(substr(generated_at, 1, 10) AS DATE)) AS days,
       lpad(CAST(CAST(substr(generated_at, 1, 4) AS BIGINT) + 2 AS VARCHAR), 4, '0') || substr(generated_at, 5, 6) AS two_years_on FROM eval_cases WHERE generated_at IS NOT NULL"""
)
def date_arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    """Days between two dates, and a date some years on whose day and month stay as they are written."""
    at = F.col("generated_at")
    day = lambda c: F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")
    later = F.concat(F.lpad((F.substring(at, 1, 4).cast("bigint") + 2).cast("string"), 4, "0"), F.substring(at, 5, 6))
    return table(spark, folder, "eval_cases").where("generated_at IS NOT NULL").select("question_id", F.datediff(day(at), day(F.col("reference_metadata.reviewed_at"))).cast("bigint").alias("days"), later.alias("two_years_on"))


@query(
    PARTS_SQL.replace("source_id, url, trim", "source_id, title, url, trim")
    + r"""SELECT DISTINCT source_id, CASE WHEN regexp_matches(host, '(^|\.)github\.com$') THEN 'github' WHEN contains(host, 'arxiv.org') THEN 'arxiv' WHEN regexp_matches(lower(coalesce(title, '')), 'official|官网|官方|release|文档|docs|pep') THEN 'official' ELSE 'web' END AS source_kind FROM e"""
)
def source_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Kind of each page by host and words of its title."""
    return table(spark, folder, "sources").select("source_id", urls.source_kind(F.col("url"), F.col("title")).alias("source_kind")).distinct()


@query()
def chunk_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Number and sizes of the chunks of each language's documents."""
    chunks = passages.chunk_rows(table(spark, folder, "documents").select("doc_id", "lang", "text"), "text", limit=200)
    return chunks.groupBy("lang").agg(F.count("*").alias("n_chunks"), F.min("n_tokens").alias("least"), F.max("n_tokens").alias("most"), F.round(F.avg("n_tokens"), 2).alias("mean"))


@query(
    r"""WITH t AS (SELECT DISTINCT item_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(snippet, '')), '[\p{L}\p{N}_]+'))) AS term FROM evidence_items), d AS (SELECT term, count(*) AS df FROM t GROUP BY term)
SELECT t.item_id, round(sum(1.0::DOUBLE / d.df), 6) AS rarity FROM t JOIN d USING (term) GROUP BY t.item_id"""
)
def term_rarity(spark: SparkSession, folder: str) -> DataFrame:
    """Sum of the inverse document frequencies of each item's words."""
    body = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("snippet", F.lit("")))
    terms = table(spark, folder, "evidence_items").select("item_id", F.explode(F.array_distinct(text.words(body))).alias("term")).distinct()
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    return terms.join(df, "term").groupBy("item_id").agg(F.round(F.sum(1.0 / F.col("df")), 6).alias("rarity"))


ISSUES_SQL = """WITH s AS (SELECT DISTINCT source_id, task_id, url, title, content, retrieved_at FROM sources),
i AS (SELECT source_id, 'no_task' AS code, 'warning' AS severity FROM s WHERE task_id IS NULL UNION SELECT source_id, 'unknown_task', 'error' FROM s WHERE task_id IS NOT NULL AND task_id NOT IN (SELECT task_id FROM training_tasks WHERE task_id IS NOT NULL)
UNION SELECT source_id, 'no_title', 'warning' FROM s WHERE trim(coalesce(title, '')) = '' UNION SELECT source_id, 'no_content', 'error' FROM s WHERE trim(coalesce(content, '')) = '' UNION SELECT source_id, 'no_retrieval_time', 'error' FROM s WHERE trim(coalesce(retrieved_at, '')) = ''
UNION SELECT source_id, 'repeated_id', 'error' FROM s GROUP BY source_id HAVING count(*) > 1)"""


def _source_rules(spark: SparkSession, folder: str) -> tuple[Rules, DataFrame]:
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = Rules("source_id").row("no_task", F.col("task_id").isNull(), WARNING).refers("unknown_task", "task_id", table(spark, folder, "training_tasks"), "task_id")
    rules.row("no_title", empty("title"), WARNING).row("no_content", empty("content")).row("no_retrieval_time", empty("retrieved_at")).unique("repeated_id", ["source_id"])
    return rules, table(spark, folder, "sources").select("source_id", "task_id", "url", "title", "content", "retrieved_at").distinct()


@query(ISSUES_SQL + " SELECT * FROM i")
def source_issues(spark: SparkSession, folder: str) -> DataFrame:
    """What the rules object to in the pages."""
    rules, rows = _source_rules(spark, folder)
    return rules.issues(rows)


@query(ISSUES_SQL + " SELECT DISTINCT source_id FROM s WHERE source_id NOT IN (SELECT source_id FROM i WHERE severity = 'error')")
def accepted_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Pages without an error."""
    rules, rows = _source_rules(spark, folder)
    return rules.accepted(rows).select("source_id")


@query(
    """WITH e AS (SELECT user_id, count(*) AS n, count(DISTINCT event_id) AS n_ids, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id),
b AS (SELECT user_id, count(*) FILTER (event_id <= before) AS breaks FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY user_id)
SELECT user_id, n, n = n_ids AS unique_ids, breaks = 0 AS rising, last <> 'error' AS ended_well, n = n_ids AND breaks = 0 AND last <> 'error' AS valid FROM e JOIN b USING (user_id)"""
)
def trace_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each user's log has unique, rising numbers and a good end."""
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folded = events.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"), F.max_by("event_type", "event_id").alias("last"))
    seen = ordered.previous(events.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "event_id", "before")
    breaks = seen.groupBy("user_id").agg(F.count_if(F.col("event_id") <= F.col("before")).alias("breaks"))
    unique, rising, well = F.col("n") == F.col("n_ids"), F.col("breaks") == 0, F.col("last") != "error"
    return folded.join(breaks, "user_id").select("user_id", "n", unique.alias("unique_ids"), rising.alias("rising"), well.alias("ended_well"), (unique & rising & well).alias("valid"))


@query(
    """WITH d AS (SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((source, lang), (source), ()))
SELECT source, lang, n, chars FROM d"""
)
def corpus_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and characters by source and language, by source, and in all."""
    rows = table(spark, folder, "documents")
    return rows.groupingSets([[F.col("source"), F.col("lang")], [F.col("source")], []], "source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))

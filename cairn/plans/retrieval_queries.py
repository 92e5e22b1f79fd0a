"""Queries of retrieval: scoring, fusion, merging, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import similarity, text, urls
from cairn.operators import ordered, overlap, ranking
from cairn.plans.catalog import query
from cairn.plans.text_queries import TERMS_SQL
from cairn.plans.url_queries import IDENTITY_SQL, PARTS_SQL
from cairn.sources.tables import table


def _best_documents(spark: SparkSession, folder: str, prompts: DataFrame) -> DataFrame:
    terms = prompts.select("case_id", F.explode(text.query_terms(F.col("query"))).alias("term")).distinct()
    return ranking.bm25_topk(table(spark, folder, "documents"), "doc_id", "text", terms, "case_id", "term")


@query(
    f"""WITH q AS (SELECT DISTINCT case_id, unnest({TERMS_SQL}) AS term FROM eval_prompts),
d AS (SELECT doc_id, lower(text) AS t, greatest(len(regexp_extract_all(text, '[^\\s\\p{{Z}}\\x{{85}}\\x{{1c}}-\\x{{1f}}]+')), 1) AS n FROM documents WHERE text IS NOT NULL),
m AS (SELECT count(*) AS docs, greatest(avg(n), 1.0) AS mean FROM d), w AS (SELECT DISTINCT term FROM q),
c AS (SELECT doc_id, n, term, CAST((length(t) - length(replace(t, term, ''))) / length(term) AS BIGINT) AS tf FROM d, w WHERE contains(t, term)),
f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
g AS (SELECT c.doc_id, c.term, ln(1 + (m.docs - f.df + 0.5) / (f.df + 0.5)) * c.tf * 2.2 / (c.tf + 1.2 * (0.25 + 0.75 * c.n / m.mean)) AS gain FROM c JOIN f USING (term), m),
s AS (SELECT q.case_id, g.doc_id, sum(g.gain) AS raw FROM q JOIN g USING (term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(raw, 9) DESC, doc_id) AS place, max(raw) OVER (PARTITION BY case_id) AS peak FROM s)
SELECT case_id, doc_id, place, round(raw / peak, 6) AS score FROM r WHERE place <= 10"""
)
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every test query, over the whole corpus."""
    return _best_documents(spark, folder, table(spark, folder, "eval_prompts"))


@query(
    PARTS_SQL.replace("SELECT DISTINCT source_id, url,", "SELECT DISTINCT source_id, task_id, authority, url,")
    + f""", ids AS (SELECT task_id, authority, source_id, {IDENTITY_SQL} AS identity FROM e WHERE task_id IS NOT NULL AND authority IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY task_id, authority ORDER BY source_id) AS place FROM ids WHERE identity <> ''),
best AS (SELECT task_id, identity, authority, min(place) AS place FROM ranked GROUP BY 1, 2, 3),
scored AS (SELECT task_id, identity, round(sum(1.0::DOUBLE / (60 + place)), 9) AS score, count(*) AS n_streams, min(place) AS best_rank FROM best GROUP BY 1, 2),
fused AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, n_streams DESC, best_rank, identity DESC) AS fused_rank FROM scored)
SELECT task_id, identity, score, n_streams, best_rank, fused_rank FROM fused WHERE fused_rank <= 48"""
)
def rank_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """The page rankings of each task, one for each authority, fused by URL identity."""
    rows = table(spark, folder, "sources").select("source_id", "task_id", "authority", "url").distinct().where("task_id IS NOT NULL AND authority IS NOT NULL")
    rows = rows.withColumn("identity", urls.url_identity(F.col("url"))).where("identity <> ''")
    streams = ordered.numbered(rows, ["task_id", "authority"], ["source_id", "url"], "place").withColumn("place", F.col("place").cast("int"))
    return ranking.fuse_ranks(streams, "task_id", "identity", "authority", "place")


@query(
    PARTS_SQL.replace("source_id, url, trim(coalesce(url, '')) AS raw FROM sources", "item_id, title, snippet, page_excerpt, published, url, trim(coalesce(url, '')) AS raw FROM evidence_items")
    + f""", i AS (SELECT item_id, title, snippet, page_excerpt, published, {IDENTITY_SQL} AS identity FROM e)
SELECT identity, count(*) AS n_rows, arg_max(snippet, (length(snippet), snippet)) FILTER (snippet IS NOT NULL) AS snippet, arg_max(md5(page_excerpt), (length(page_excerpt), page_excerpt)) FILTER (page_excerpt IS NOT NULL) AS excerpt_digest,
       arg_min(title, item_id) FILTER (coalesce(title, '') <> '') AS title, arg_min(published, item_id) FILTER (coalesce(published, '') <> '') AS published FROM i WHERE identity <> '' GROUP BY identity"""
)
def merge_best_text(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence merged by URL identity: the longest texts and the first titles and dates."""
    rows = table(spark, folder, "evidence_items").select("item_id", "title", "snippet", "page_excerpt", "published", "url").distinct().withColumn("identity", urls.url_identity(F.col("url"))).where("identity <> ''")
    out = overlap.merge_best(rows, "identity", "item_id", ["snippet", "page_excerpt"], ["title", "published"])
    return out.select("identity", "n_rows", "snippet", F.md5(F.col("page_excerpt").cast("binary")).alias("excerpt_digest"), "title", "published")


METRICS_SQL = """
WITH r AS (SELECT task_id, source_id, row_number() OVER (PARTITION BY task_id ORDER BY source_id) AS place FROM (SELECT DISTINCT task_id, source_id FROM sources WHERE task_id IS NOT NULL)),
t AS (SELECT DISTINCT task_id, source_id FROM sources WHERE task_id IS NOT NULL AND authority = 'official'), n AS (SELECT task_id, count(*) AS n FROM t GROUP BY 1),
h AS (SELECT r.task_id, count(*) AS hits, min(place) AS best, sum(1 / log2(place + 1)) AS dcg FROM r JOIN t USING (task_id, source_id) WHERE place <= 10 GROUP BY 1)
SELECT a.task_id, CASE WHEN n.n IS NOT NULL THEN round(coalesce(hits, 0) / n.n, 4) END AS recall, round(coalesce(hits, 0) / 10, 4) AS precision, CASE WHEN n.n IS NOT NULL THEN round(coalesce(1 / best, 0), 4) END AS reciprocal_rank,
       CASE WHEN n.n IS NOT NULL THEN round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n.n, 10) + 1), lambda i: 1 / log2(i + 1))), 4) END AS ndcg
FROM (SELECT DISTINCT task_id FROM r) a LEFT JOIN n USING (task_id) LEFT JOIN h USING (task_id)"""


@query(METRICS_SQL)
def ir_metrics_at_10(spark: SparkSession, folder: str) -> DataFrame:
    """Recall, precision, reciprocal rank and nDCG of each task's page order, official pages being relevant."""
    pages = table(spark, folder, "sources").where("task_id IS NOT NULL")
    ranked = ranking.quota_topk(pages.select("task_id", "source_id").distinct(), ["task_id"], [F.col("source_id")], 10)
    everyone = pages.select("task_id").distinct()
    relevant = pages.where("authority = 'official'").select("task_id", "source_id").distinct()
    return ranking.retrieval_metrics(ranked, relevant, "task_id", "source_id", "place").join(everyone, "task_id", "left_semi")


@query(
    r"""WITH t AS (SELECT DISTINCT item_id, list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[\p{L}\p{N}_]+')) AS a, list_distinct(regexp_extract_all(lower(coalesce(snippet, '')), '[\p{L}\p{N}_]+')) AS b,
 regexp_extract_all(lower(coalesce(title, '')), '[\p{L}\p{N}_]+') AS wa, regexp_extract_all(lower(coalesce(snippet, '')), '[\p{L}\p{N}_]+') AS wb FROM evidence_items),
g AS (SELECT *, len(list_intersect(a, b)) AS n, CASE WHEN len(wa) >= 2 THEN list_distinct(list_transform(range(1, len(wa)), lambda i: wa[i] || ' ' || wa[i + 1])) ELSE [] END AS ga,
 CASE WHEN len(wb) >= 2 THEN list_distinct(list_transform(range(1, len(wb)), lambda i: wb[i] || ' ' || wb[i + 1])) ELSE [] END AS gb FROM t)
SELECT item_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(2 * n / (len(a) + len(b)), 6) END AS f1, round(least(1.0, n / greatest(1, least(len(b), 12))), 6) AS support,
 round(CASE WHEN len(ga) > 0 AND len(gb) > 0 THEN len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb))) ELSE 0.0 END, 6) AS bigram_jaccard FROM g"""
)
def overlap_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Token F1, support and bigram similarity of each title and snippet."""
    rows = table(spark, folder, "evidence_items").select("item_id", "title", "snippet").distinct()
    a, b = text.words(F.col("title")), text.words(F.col("snippet"))
    sets = rows.select("item_id", F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b"), similarity.ngrams(a, 2).alias("ga"), similarity.ngrams(b, 2).alias("gb"))
    return sets.select("item_id", F.round(similarity.token_f1(F.col("a"), F.col("b")), 6).alias("f1"), F.round(similarity.support(F.col("b"), F.col("a")), 6).alias("support"), F.round(similarity.jaccard(F.col("ga"), F.col("gb")), 6).alias("bigram_jaccard")).distinct()


@query(
    rf"""WITH p AS (SELECT DISTINCT s.source_id, lower(coalesce(s.title, '')) AS ti, lower(coalesce(s.content, '')) AS co, lower(coalesce(s.url, '')) AS ur, s.authority, t.content.goal AS query FROM sources s JOIN training_tasks t USING (task_id)), k AS (SELECT *, {TERMS_SQL} AS terms FROM p)
SELECT DISTINCT source_id, round(coalesce(list_sum(list_transform(terms, lambda x: CASE WHEN contains(ti, x) THEN 4.0 ELSE 0 END + CASE WHEN contains(co, x) THEN 1.0 ELSE 0 END + CASE WHEN contains(ur, x) THEN 1.5 ELSE 0 END)), 0) + CASE WHEN authority = 'official' THEN 1.5 ELSE 0 END, 4)::DOUBLE AS score FROM k"""
)
def candidate_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted hits of the terms of its task's goal in title, content and URL of each page."""
    goals = table(spark, folder, "training_tasks").select("task_id", text.query_terms(F.col("content.goal")).alias("terms"))
    rows = table(spark, folder, "sources").select("source_id", "task_id", "authority", *[F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "content", "url")]).join(goals, "task_id")
    hit = lambda c, w, term: F.when(F.contains(F.col(c), term), w).otherwise(0.0)
    hits = F.aggregate("terms", F.lit(0.0), lambda s, x: s + hit("title", 4.0, x) + hit("content", 1.0, x) + hit("url", 1.5, x))
    return rows.select("source_id", F.round(hits + F.when(F.col("authority") == "official", 1.5).otherwise(0.0), 4).alias("score")).distinct()


@query(
    """WITH d AS (SELECT doc_id, source, fetched_at FROM documents)
SELECT doc_id, CASE WHEN fetched_at IS NULL THEN 'unknown_date' WHEN fetched_at > TIMESTAMPTZ '2026-01-01 00:00:00+00' THEN 'after_cutoff' WHEN fetched_at < TIMESTAMPTZ '2025-01-01 00:00:00+00' THEN 'stale' ELSE 'current' END AS freshness FROM d"""
)
def freshness_states(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's date against a cutoff; an unknown date is never guessed."""
    at = F.col("fetched_at")
    state = F.when(at.isNull(), "unknown_date").when(at > F.lit("2026-01-01 00:00:00+00:00").cast("timestamp"), "after_cutoff").when(at < F.lit("2025-01-01 00:00:00+00:00").cast("timestamp"), "stale").otherwise("current")
    return table(spark, folder, "documents").select("doc_id", state.alias("freshness"))


@query(
    """WITH p AS (SELECT case_id AS id, query AS prompt, 'eval_prompts' AS origin FROM eval_prompts UNION ALL SELECT question_id, question, 'eval_cases' FROM eval_cases)
SELECT id, trim(prompt) AS prompt, origin FROM p WHERE id IS NOT NULL AND trim(coalesce(prompt, '')) <> ''"""
)
def prompt_union(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts of two sources of different layout, without empty ones."""
    a = table(spark, folder, "eval_prompts").select(F.col("case_id").alias("id"), F.col("query").alias("prompt"), F.lit("eval_prompts").alias("origin"))
    b = table(spark, folder, "eval_cases").select(F.col("question_id").alias("id"), F.col("question").alias("prompt"), F.lit("eval_cases").alias("origin"))
    return a.unionByName(b).withColumn("prompt", F.trim("prompt")).where("id IS NOT NULL AND coalesce(prompt, '') <> ''")


@query(
    """WITH t AS (SELECT DISTINCT task_id FROM training_tasks WHERE task_id IS NOT NULL), s AS (SELECT DISTINCT source_id, task_id FROM sources)
SELECT 'orphan_sources' AS issue, count(*) AS n FROM s WHERE task_id IS NOT NULL AND task_id NOT IN (SELECT task_id FROM t)
UNION ALL SELECT 'sources_without_task', count(*) FROM s WHERE task_id IS NULL UNION ALL SELECT 'tasks_without_sources', count(*) FROM t WHERE task_id NOT IN (SELECT task_id FROM s WHERE task_id IS NOT NULL)
UNION ALL SELECT 'count_mismatch', count(*) FROM (SELECT t.task_id FROM (SELECT DISTINCT task_id, metrics.source_count AS m FROM training_tasks) t LEFT JOIN (SELECT task_id, count(*) AS n FROM s GROUP BY 1) c USING (task_id) WHERE coalesce(c.n, 0) <> coalesce(t.m, 0))"""
)
def reference_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Foreign keys between tasks and pages, each rule one check."""
    tasks = table(spark, folder, "training_tasks").select("task_id", F.col("metrics.source_count").alias("m")).distinct()
    pages = table(spark, folder, "sources").select("source_id", "task_id").distinct()
    counted = pages.where("task_id IS NOT NULL").groupBy("task_id").agg(F.count("*").alias("n"))
    rules = {
        "orphan_sources": pages.where("task_id IS NOT NULL").join(tasks, "task_id", "left_anti"), "sources_without_task": pages.where("task_id IS NULL"),
        "tasks_without_sources": tasks.where("task_id IS NOT NULL").select("task_id").distinct().join(counted, "task_id", "left_anti"),
        "count_mismatch": tasks.join(counted, "task_id", "left").where("coalesce(n, 0) <> coalesce(m, 0)"),
    }
    out = None
    for issue, df in rules.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(issue).alias("issue"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """WITH RECURSIVE t AS (SELECT DISTINCT task_id, task_group_id, domain, rewrite_family, round FROM training_tasks), o AS (SELECT *, row_number() OVER (ORDER BY round NULLS FIRST, task_id NULLS FIRST) AS i, coalesce(task_group_id, '') AS g, coalesce(domain, '') AS d, coalesce(rewrite_family, '') AS f FROM t),
w AS (SELECT CAST(0 AS BIGINT) AS i, 0 AS n, false AS taken, MAP {'': 0} AS gs, MAP {'': 0} AS ds, MAP {'': 0} AS fs UNION ALL SELECT i, n + ok::INT, ok, CASE WHEN ok THEN map_concat(gs, MAP {g: coalesce(gs[g], 0) + 1}) ELSE gs END, CASE WHEN ok THEN map_concat(ds, MAP {d: coalesce(ds[d], 0) + 1}) ELSE ds END, CASE WHEN ok THEN map_concat(fs, MAP {f: coalesce(fs[f], 0) + 1}) ELSE fs END
 FROM (SELECT o.i, o.g, o.d, o.f, w.n, w.gs, w.ds, w.fs, w.n < 200 AND coalesce(w.gs[o.g], 0) < 4 AND coalesce(w.ds[o.d], 0) < 60 AND coalesce(w.fs[o.f], 0) < 80 AS ok FROM w JOIN o ON o.i = w.i + 1) s)
SELECT task_id, task_group_id, domain, rewrite_family, round FROM w JOIN o USING (i) WHERE taken"""
)
def quota_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Two hundred tasks under several quotas at once, taken greedily in order; see the operator for why it is sequential."""
    from cairn.operators import selection

    tasks = table(spark, folder, "training_tasks").select("task_id", "task_group_id", "domain", "rewrite_family", "round").distinct()
    return selection.greedy_quota(tasks, ["round", "task_id"], {"task_group_id": 4, "domain": 60, "rewrite_family": 80}, 200)


@query(
    """WITH d AS (SELECT item_id, published, authority.rank AS rank, evidence_origin FROM evidence_items), f AS (SELECT DISTINCT item_id, published, rank, evidence_origin FROM d)
SELECT item_id, coalesce(CAST(rank AS BIGINT), -1) AS rank, evidence_origin = 'fetched_page_body' AS fetched, row_number() OVER (PARTITION BY evidence_origin ORDER BY rank DESC NULLS LAST, item_id) AS place
FROM f QUALIFY place <= 50"""
)
def origin_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty highest-ranked items of each origin."""
    rows = table(spark, folder, "evidence_items").select("item_id", "published", F.col("authority.rank").alias("rank"), "evidence_origin").distinct()
    top = ranking.quota_topk(rows, ["evidence_origin"], [F.desc_nulls_last("rank"), F.asc("item_id")], 50)
    return top.select("item_id", F.coalesce(F.col("rank").cast("bigint"), F.lit(-1)).alias("rank"), (F.col("evidence_origin") == "fetched_page_body").alias("fetched"), "place")


@query(
    """WITH p AS (SELECT host, CAST(fetched_at AT TIME ZONE 'UTC' AS DATE) AS day, doc_id FROM documents WHERE host IS NOT NULL AND fetched_at IS NOT NULL), m AS (SELECT host, max(day) FILTER (day <= DATE '2026-01-01') AS newest FROM p GROUP BY host)
SELECT p.doc_id, CASE WHEN p.day = m.newest THEN 96 WHEN p.day > DATE '2026-01-01' THEN 48 ELSE 0 END AS bonus FROM p JOIN m USING (host)"""
)
def temporal_bonus(spark: SparkSession, folder: str) -> DataFrame:
    """The newest eligible documents of each host and later ones marked; the newest day is aggregated first, so hot hosts are cheap."""
    rows = table(spark, folder, "documents").where("host IS NOT NULL AND fetched_at IS NOT NULL").select("doc_id", "host", F.to_date(F.to_utc_timestamp("fetched_at", F.current_timezone())).alias("day"))
    cutoff = F.lit("2026-01-01").cast("date")
    newest = rows.where(F.col("day") <= cutoff).groupBy("host").agg(F.max("day").alias("newest"))
    bonus = F.when(F.col("day") == F.col("newest"), 96).when(F.col("day") > cutoff, 48).otherwise(0)
    return rows.join(newest, "host", "left").select("doc_id", bonus.alias("bonus"))


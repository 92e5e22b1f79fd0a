"""Queries that check citations, facts and answers, and reports on reviews and experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import terms
from cairn.operators import experiments, grounding, ordered, ranking
from cairn.plans.catalog import query
from cairn.sources.tables import table

_PLAIN = "regexp_replace(lower(trim(coalesce(url, ''))), '/+$', '')"
_TOKENS = "list_distinct(list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z][A-Za-z0-9_-]{{2,}}|[㐀-鿿]{{2,}}'), lambda x: lower(x)))"
_HOST = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(trim(coalesce(url, '')), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^.*@', ''), ':\d*$', ''), '\.+$', ''), '^www\.', '')"
_RESULTS = "['" + "', '".join(grounding.RESULT_HOSTS) + "']"


@query(
    rf"""WITH c AS (SELECT DISTINCT s.task_id, s.source_id, s.url, s.authority, s.content, coalesce(t.content.goal, '') AS answer, {_PLAIN.replace("url", "s.url")} AS p FROM sources s JOIN training_tasks t USING (task_id)),
o AS (SELECT *, CASE WHEN authority = 'official' THEN trim(coalesce(content, '')) ELSE '' END AS own FROM c),
e AS (SELECT {_PLAIN} AS p, trim(coalesce(source_excerpt, page_excerpt)) AS body FROM evidence_items WHERE {_PLAIN} <> '' AND trim(coalesce(source_excerpt, page_excerpt, '')) <> ''),
l AS (SELECT p, arg_max(body, (length(body), body)) AS body FROM e GROUP BY p), n AS (SELECT task_id, p, count(*) AS n FROM c WHERE p <> '' GROUP BY 1, 2),
j AS (SELECT o.*, CASE WHEN own <> '' THEN own ELSE coalesce(l.body, '') END AS body, coalesce(n.n, 0) > 1 AS repeated FROM o LEFT JOIN l USING (p) LEFT JOIN n USING (task_id, p)),
k AS (SELECT *, coalesce(regexp_matches(url, '(?i)^\s*https?://[^/?#\s]'), false) AS url_valid, {_HOST} AS host, lower(regexp_extract(trim(coalesce(url, '')), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)) AS path, {_TOKENS.format("body")} AS b, {_TOKENS.format("answer")} AS a FROM j),
r AS (SELECT *, url_valid AND (list_contains({_RESULTS}, host) OR (len(list_filter({_RESULTS}, lambda x: ends_with(host, '.' || x))) > 0 AND (path IN ('', '/') OR contains(path, 'search')))) AS result_page,
  CASE WHEN own <> '' THEN 'citation' WHEN body <> '' THEN 'retrieved' ELSE 'none' END AS evidence FROM k)
SELECT task_id AS group_id, source_id AS ref_id, url_valid, result_page, repeated, contains(lower(answer), lower(source_id)) OR (coalesce(url, '') <> '' AND contains(lower(answer), lower(url))) AS referenced, evidence,
 CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(least(1.0::DOUBLE, len(list_intersect(a, b)) / greatest(1, least(len(b), 12))), 4) END AS support,
 array_to_string(list_filter([CASE WHEN NOT url_valid THEN 'invalid_url' END, CASE WHEN result_page THEN 'search_result_page' END, CASE WHEN evidence = 'none' THEN 'missing_evidence' END], lambda x: x IS NOT NULL), ',') AS issues FROM r"""
)
def citation_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Every page of a task as a citation of its goal: URL, evidence, support and issues."""
    tasks = table(spark, folder, "training_tasks").select("task_id", F.col("content.goal").alias("answer"))
    pages = table(spark, folder, "sources").select("task_id", "source_id", "url", "authority", "content").join(tasks, "task_id").distinct()
    pages = pages.withColumn("inline", F.when(F.col("authority") == "official", F.col("content")))
    items = table(spark, folder, "evidence_items").select("url", F.coalesce("source_excerpt", "page_excerpt").alias("body"))
    return grounding.citation_checks(pages, "task_id", "source_id", "url", "answer", F.col("inline"), grounding.longest_texts(items, "url", "body")).drop("plain_url")


_NORMAL = r"trim(regexp_replace(lower(coalesce({0}, '')), '[\s\p{{Z}}]+', ' ', 'g'))"
_STOPS = "['" + "', '".join(terms.SIGNAL_STOPS) + "']"
_RAW = "list_filter(list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z][A-Za-z0-9_-]{{2,}}|[㐀-鿿]{{2,}}'), lambda x: lower(x)), lambda x: NOT list_contains(" + _STOPS + ", x))"


def _spread(column: str, whole: bool, *sizes: int) -> str:
    grams = "flatten([" + ", ".join(f"list_transform(range(1, greatest(length(t) - {n} + 2, 1)), lambda i: substr(t, CAST(i AS INT), {n}))" for n in sizes) + "])"
    own = f"list_concat([t], {grams})" if whole else grams
    return f"list_filter(list_distinct(flatten(list_transform({_RAW.format(column)}, lambda t: CASE WHEN regexp_matches(t, '^[㐀-鿿]') THEN {own} ELSE [t] END))), lambda x: NOT list_contains({_STOPS}, x))"


@query(
    rf"""WITH p AS (SELECT DISTINCT s.source_id, s.title, s.content, t.content.goal AS goal FROM sources s JOIN training_tasks t USING (task_id)),
w AS (SELECT source_id, {_NORMAL.format("title")} AS e, {_NORMAL.format("content")} AS o, {_spread("goal", True, 2, 3, 4)} AS a, {_spread("content", True, 2, 3, 4)} AS b, {_spread("goal", False, 2)} AS c, {_spread("content", False, 2)} AS d FROM p),
x AS (SELECT *, list_distinct(regexp_extract_all(e, '[A-Za-z0-9_]+|[㐀-鿿]')) AS want, list_distinct(regexp_extract_all(o, '[A-Za-z0-9_]+|[㐀-鿿]')) AS seen, len(list_intersect(a, b)) AS n_a, len(list_intersect(c, d)) AS n_c FROM w)
SELECT DISTINCT source_id, e <> '' AND o <> '' AND (contains(o, e) OR (len(want) > 0 AND len(list_intersect(want, seen)) / len(want) >= 0.8)) AS title_present, len(a) AS n_required, n_a AS n_matched,
 round(n_a / greatest(len(a), 1), 4) AS score, round(n_c / greatest(len(c), 1), 4) AS compact_score,
 CASE WHEN n_a >= CASE WHEN len(a) <= 2 THEN 2 ELSE 3 END AND n_a / greatest(len(a), 1) >= 0.6 THEN 'direct_terms' WHEN n_c >= greatest(3, least(10, floor((len(c) + 1) / 2))) AND n_c / greatest(len(c), 1) >= 0.5 THEN 'compact_terms' ELSE 'none' END AS basis FROM x"""
)
def goal_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each page's body holds its own title, and how far it covers its task's goal."""
    goals = table(spark, folder, "training_tasks").select("task_id", F.col("content.goal").alias("goal"))
    rows = table(spark, folder, "sources").select("source_id", "task_id", "title", "content").join(goals, "task_id").distinct()
    found = grounding.coverage(F.col("goal"), F.col("content"), terms.SIGNAL_STOPS)
    out = rows.select("source_id", grounding.fact_present(F.col("title"), F.col("content")).alias("title_present"), F.explode(F.array(found)).alias("c"))
    return out.select("source_id", "title_present", "c.*").distinct()


@query(
    rf"""WITH t AS (SELECT DISTINCT task_id, instruction FROM training_tasks WHERE task_id IS NOT NULL), l AS (SELECT task_id, unnest(string_split(coalesce(instruction, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(instruction, ''), chr(10))) + 1)) AS line_no FROM t),
k AS (SELECT task_id, line_no, {_TOKENS.format("line")} AS a FROM l), s AS (SELECT DISTINCT task_id, {_TOKENS.format("content")} AS b FROM sources WHERE task_id IS NOT NULL),
m AS (SELECT k.task_id, k.line_no, max(len(list_intersect(a, b)) / len(a)) AS best FROM k LEFT JOIN s USING (task_id) WHERE len(a) > 0 GROUP BY 1, 2)
SELECT task_id AS group_id, line_no, round(coalesce(best, 0), 4) AS best, coalesce(best, 0) >= 0.12 AS aligned FROM m"""
)
def line_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of each task's instruction against the pages of the task."""
    answers = table(spark, folder, "training_tasks").where("task_id IS NOT NULL").select("task_id", "instruction").distinct()
    return grounding.aligned_lines(answers, "task_id", "instruction", table(spark, folder, "sources").where("task_id IS NOT NULL").select("task_id", "content"), "content")


_FORM = r"translate(regexp_replace(regexp_replace(trim(regexp_replace(lower(coalesce({0}, '')), '[\s\p{{Z}}]+', ' ', 'g')), '^[ ?？!！。.,，]+', ''), '[ ?？!！。.,，]+$', ''), '零〇一二三四五六七八九', '00123456789')"


@query(
    rf"""WITH f AS (SELECT DISTINCT id, form, list_distinct(regexp_extract_all(form, '[a-z0-9_]+|[㐀-鿿]')) AS t FROM (SELECT case_id AS id, {_FORM.format("query")} AS form FROM eval_prompts UNION ALL SELECT question_id, {_FORM.format("question")} FROM eval_cases) WHERE form <> '' AND id IS NOT NULL),
p AS (SELECT a.id, b.id AS best_key, CASE WHEN a.form = b.form THEN 1.0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) END AS score FROM f a JOIN f b ON a.id <> b.id
 WHERE a.form = b.form OR (len(a.t) >= 5 AND len(b.t) >= 5 AND len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) >= 0.8)),
r AS (SELECT id, best_key, round(score, 6) AS score, row_number() OVER (PARTITION BY id ORDER BY round(score, 6) DESC, best_key) AS place FROM p WHERE score >= 0.6)
SELECT id, best_key, CAST(score AS DOUBLE) AS score FROM r WHERE place = 1"""
)
def similar_questions(spark: SparkSession, folder: str) -> DataFrame:
    """For every question the most similar other one."""
    a = table(spark, folder, "eval_prompts").select(F.col("case_id").alias("id"), "query")
    every = a.unionByName(table(spark, folder, "eval_cases").select(F.col("question_id").alias("id"), F.col("question").alias("query")))
    return grounding.best_similar(every, every, "id", "query")


#: Reviews made from the cases: an A and a B of every case but some, with scores from a hash of their keys.
_REVIEWS = """v AS (SELECT DISTINCT question_id, domain, unnest(['A', 'B']) AS blind_label FROM eval_cases),
h AS (SELECT *, md5(question_id || blind_label) AS h FROM v), w AS (SELECT question_id, domain, blind_label, 1 + (ascii(substr(h, 1, 1)) % 5) AS accuracy, 1 + (ascii(substr(h, 2, 1)) % 5) AS coverage, 1 + (ascii(substr(h, 3, 1)) % 5) AS clarity FROM h WHERE ascii(substr(h, 4, 1)) % 7 <> 0)"""
_SCORES = ["accuracy", "coverage", "clarity"]


def _reviews(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "eval_cases").select("question_id", "domain").distinct().withColumn("blind_label", F.explode(F.array(F.lit("A"), F.lit("B"))))
    digest = F.md5(F.concat("question_id", "blind_label").cast("binary"))
    score = lambda i: 1 + F.ascii(F.substring(digest, i, 1)) % 5
    return rows.where(F.ascii(F.substring(digest, 4, 1)) % 7 != 0).select("question_id", "domain", "blind_label", *[score(i).alias(c) for i, c in enumerate(_SCORES, 1)])


@query(f"WITH {_REVIEWS} SELECT domain, count(*) AS n_reviews, count(DISTINCT question_id) AS n_questions, round(avg(accuracy), 4) AS accuracy, round(avg(coverage), 4) AS coverage, round(avg(clarity), 4) AS clarity FROM w GROUP BY domain")
def review_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Mean scores of reviews by domain."""
    return experiments.review_means(_reviews(spark, folder), "domain", "question_id", _SCORES)


_PAIRED = """b AS (SELECT question_id, max(CASE WHEN blind_label = 'A' THEN accuracy + coverage + clarity END) AS a_total, max(CASE WHEN blind_label = 'B' THEN accuracy + coverage + clarity END) AS b_total FROM w GROUP BY 1 HAVING count(*) = 2 AND count(DISTINCT blind_label) = 2),
k AS (SELECT *, CASE WHEN a_total > b_total THEN 'A' WHEN b_total > a_total THEN 'B' ELSE 'tie' END AS winner FROM b)"""


@query(f"WITH {_REVIEWS}, {_PAIRED} SELECT question_id, a_total, b_total, winner FROM k")
def review_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Blind comparisons of the questions that have both reviews."""
    return experiments.blind_pairs(_reviews(spark, folder), "question_id", "blind_label", _SCORES)


@query(
    f"""WITH {_REVIEWS}, {_PAIRED}, y AS (SELECT question_id, CASE WHEN ascii(substr(md5(question_id), 1, 1)) % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS a, CASE WHEN ascii(substr(md5(question_id), 1, 1)) % 2 = 0 THEN 'candidate' ELSE 'baseline' END AS b FROM (SELECT DISTINCT question_id FROM eval_cases))
SELECT CASE winner WHEN 'A' THEN y.a WHEN 'B' THEN y.b ELSE 'tie' END AS winner, count(*) AS n FROM k JOIN y USING (question_id) GROUP BY 1"""
)
def review_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Wins by variant, after the blind labels are joined with their key table."""
    even = F.ascii(F.substring(F.md5(F.col("question_id").cast("binary")), 1, 1)) % 2 == 0
    keys = table(spark, folder, "eval_cases").select("question_id").distinct().select("question_id", F.when(even, "baseline").otherwise("candidate").alias("a_variant"), F.when(even, "candidate").otherwise("baseline").alias("b_variant"))
    return experiments.unblinded(experiments.blind_pairs(_reviews(spark, folder), "question_id", "blind_label", _SCORES), keys, "question_id")


_RUN = "SELECT user_id, avg(value) FILTER (event_type = 'view') AS recall, avg(value) FILTER (event_type = 'click') AS accuracy, avg(value) FILTER (event_type = 'purchase') AS citation, count(*) AS latency FROM events WHERE event_id % 2 = {0} GROUP BY 1"
_METRICS = ["recall", "accuracy", "citation"]


def _run(spark: SparkSession, folder: str, side: int) -> DataFrame:
    rows = table(spark, folder, "events").where(F.col("event_id") % 2 == side)
    of = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    return rows.groupBy("user_id").agg(of("view").alias("recall"), of("click").alias("accuracy"), of("purchase").alias("citation"), F.count("*").alias("latency"))


_CHANGED = f"""b AS ({_RUN.format(0)}), c AS ({_RUN.format(1)}), d AS (SELECT user_id, round(c.recall - b.recall, 8) AS recall, round(c.accuracy - b.accuracy, 8) AS accuracy, round(c.citation - b.citation, 8) AS citation, c.latency - b.latency AS latency FROM b JOIN c USING (user_id)),
s AS (SELECT *, coalesce(recall > 0, false) OR coalesce(accuracy > 0, false) OR coalesce(citation > 0, false) AS rise, coalesce(recall < 0, false) OR coalesce(accuracy < 0, false) OR coalesce(citation < 0, false) AS fall FROM d)"""


@query(f"WITH {_CHANGED} SELECT user_id, recall, accuracy, citation, CASE WHEN rise AND fall THEN 'mixed' WHEN rise THEN 'better' WHEN fall THEN 'worse' WHEN recall IS NOT NULL OR accuracy IS NOT NULL OR citation IS NOT NULL THEN 'same' ELSE 'unknown' END AS outcome FROM s")
def case_differences(spark: SparkSession, folder: str) -> DataFrame:
    """How each user's metrics change between two runs, and whether for better or worse."""
    return experiments.case_changes(_run(spark, folder, 0), _run(spark, folder, 1), "user_id", _METRICS, 8)


@query(
    f"""WITH {_CHANGED}, g AS (SELECT user_id % 50 AS bucket, count(*) AS n, avg(recall) AS recall, avg(accuracy) AS accuracy, avg(citation) AS citation, avg(latency) AS latency FROM d GROUP BY 1),
k AS (SELECT *, CAST(recall IS NOT NULL AS INT) + CAST(accuracy IS NOT NULL AS INT) + CAST(citation IS NOT NULL AS INT) AS known, coalesce(recall > 0, false) OR coalesce(accuracy > 0, false) OR coalesce(citation > 0, false) AS rise, coalesce(recall < 0, false) OR coalesce(accuracy < 0, false) OR coalesce(citation < 0, false) AS fall FROM g)
SELECT bucket, n, CASE WHEN n < 5 OR known < 2 THEN 'continue' WHEN rise AND fall THEN 'partial' WHEN rise AND coalesce(latency > 0, false) THEN 'partial' WHEN rise THEN 'adopt' WHEN fall THEN 'roll_back' ELSE 'continue' END AS decision FROM k"""
)
def promotion_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """What the changes of each of fifty groups of users suggest."""
    base, new = _run(spark, folder, 0), _run(spark, folder, 1)
    columns = [*_METRICS, "latency"]
    rows = base.join(new.select("user_id", *[F.col(c).alias(f"new_{c}") for c in columns]), "user_id").select("user_id", *[F.round(F.col(f"new_{c}") - F.col(c), 8).alias(c) for c in columns])
    groups = rows.groupBy((F.col("user_id") % 50).alias("bucket")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])
    return groups.select("bucket", "n", experiments.decision(F.col("n"), [F.col(c) for c in _METRICS], F.col("latency")).alias("decision"))


@query(
    """WITH t AS (SELECT DISTINCT task_id, instruction, snapshot_time FROM training_tasks WHERE task_id IS NOT NULL), s AS (SELECT DISTINCT source_id, task_id, content FROM sources),
n AS (SELECT task_id, count(*) AS n, count(*) FILTER (trim(coalesce(content, '')) <> '') AS bodies, count(*) FILTER (length(content) > 2000) AS long FROM s GROUP BY 1),
k AS (SELECT CASE WHEN snapshot_time IS NULL THEN 'engineering' WHEN trim(coalesce(instruction, '')) = '' THEN 'answer' WHEN coalesce(n, 0) = 0 THEN 'retrieval' WHEN coalesce(bodies, 0) = 0 THEN 'extraction' WHEN coalesce(long, 0) > 0 THEN 'context' ELSE 'answer' END AS stage FROM t LEFT JOIN n USING (task_id))
SELECT stage, count(*) AS n FROM k GROUP BY stage"""
)
def failure_stages(spark: SparkSession, folder: str) -> DataFrame:
    """How many tasks stop at which stage."""
    tasks = table(spark, folder, "training_tasks").where("task_id IS NOT NULL").select("task_id", "instruction", "snapshot_time").distinct()
    pages = table(spark, folder, "sources").select("source_id", "task_id", "content").distinct()
    counts = pages.groupBy("task_id").agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("content", F.lit(""))) != "").alias("bodies"), F.count_if(F.length("content") > 2000).alias("long"))
    stage = experiments.failing_stage(F.col("snapshot_time").isNotNull(), F.col("n"), F.col("bodies"), F.col("long"), F.col("instruction"))
    return tasks.join(counts, "task_id", "left").groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


_ITEMS = "i AS (SELECT task_group_id, list_sort(list_distinct(list(task_id))) AS items FROM training_tasks WHERE task_group_id IS NOT NULL AND task_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT task_id) BETWEEN 2 AND 200)"


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of 2 to 200 tasks with their sorted ids; larger ones are no list of candidates."""
    rows = table(spark, folder, "training_tasks").where("task_group_id IS NOT NULL AND task_id IS NOT NULL").select("task_group_id", "task_id").distinct()
    small = rows.groupBy("task_group_id").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 200").select("task_group_id")
    return rows.join(small, "task_group_id", "left_semi").groupBy("task_group_id").agg(F.array_sort(F.collect_list("task_id")).alias("items"))


@query(
    f"""WITH {_ITEMS}, l AS (SELECT *, len(items) AS n, greatest(1, least(10, 2 * len(items))) AS most FROM i), t AS (SELECT *, least(n, (most + 1) // 2) AS turns FROM l),
o AS (SELECT *, unnest(range(0, turns)) AS turn FROM t), r AS (SELECT *, (turn * n) // turns AS off FROM o),
v AS (SELECT task_group_id, n, most, turn * 2 + 1 AS place, list_concat(items[off + 1:], items[:off]) AS view FROM r UNION ALL SELECT task_group_id, n, most, turn * 2 + 2, list_reverse(list_concat(items[off + 1:], items[:off])) FROM r),
u AS (SELECT task_group_id, n, most, min(place) AS place, view FROM v GROUP BY ALL)
SELECT task_group_id, row_number() OVER (PARTITION BY task_group_id ORDER BY place) AS view_no, array_to_string(view, '|') AS view FROM u QUALIFY view_no <= most"""
)
def balanced_views(spark: SparkSession, folder: str) -> DataFrame:
    """Balanced orders of each group's tasks, so that no position is favoured."""
    rows = _groups(spark, folder).select("task_group_id", F.posexplode(experiments.order_views(F.col("items"))).alias("at", "view"))
    return rows.select("task_group_id", (F.col("at") + 1).alias("view_no"), F.array_join("view", "|").alias("view"))


_BATCHES = f"""{_ITEMS}, l AS (SELECT *, len(items) AS n, greatest(2, least(5, len(items))) AS size FROM i), p AS (SELECT *, unnest([0, 1]) AS pass FROM l),
s AS (SELECT *, list_filter(range(1 + 2 * pass, 2 + 2 * pass + n), lambda x: gcd(x, n) = 1)[1] * CASE WHEN pass = 1 THEN -1 ELSE 1 END AS stride, (pass * greatest(1, size // 2)) % n AS start FROM p),
w AS (SELECT *, unnest(range(0, n)) AS pos FROM s), b AS (SELECT task_group_id, pass * 1000 + pos // size AS batch, pos, items[((start + pos * stride) % n + n) % n + 1] AS item FROM w)"""


@query(f"WITH {_BATCHES} SELECT task_group_id, batch, array_to_string(list(item ORDER BY pos), '|') AS items FROM b GROUP BY 1, 2")
def nomination_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Small overlapping batches of each group's tasks; every task stands in two."""
    return _batches(spark, folder).select("task_group_id", "batch", F.array_join("items", "|").alias("items"))


def _batches(spark: SparkSession, folder: str) -> DataFrame:
    rows = _groups(spark, folder).withColumn("per_pass", F.ceil(F.size("items") / F.greatest(F.lit(2), F.least(F.lit(5), F.size("items")))).cast("int"))
    rows = rows.select("task_group_id", "per_pass", F.posexplode(experiments.overlapping_batches(F.col("items"))).alias("at", "items"))
    return rows.select("task_group_id", (F.floor(F.col("at") / F.col("per_pass")) * 1000 + F.col("at") % F.col("per_pass")).alias("batch"), "items")


def _seats(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each task and batch of it, of all groups of two tasks and more; no group's tasks are held in one place."""
    rows = table(spark, folder, "training_tasks").where("task_group_id IS NOT NULL AND task_id IS NOT NULL").select("task_group_id", F.col("task_id").alias("item")).distinct()
    rows = ordered.placed(rows, ["task_group_id"], ["item"]).where("n >= 2")
    rows = rows.select("task_group_id", "item", F.explode(experiments.batches_of(F.col("seq") - 1, F.col("n"))).alias("seat"))
    return rows.select("task_group_id", (F.col("seat.turn") * 1000 + F.col("seat.batch")).alias("batch"), "item")


_SEATS = _BATCHES.replace("BETWEEN 2 AND 200", ">= 2")


@query(
    f"""WITH {_SEATS}, h AS (SELECT *, md5(item || '/' || batch) AS h FROM b), k AS (SELECT task_group_id, batch, item, ascii(substr(h, 2, 1)) AS confidence FROM h WHERE ascii(substr(h, 1, 1)) % 3 = 0),
a AS (SELECT task_group_id, item, count(*) AS appearances FROM b GROUP BY 1, 2), c AS (SELECT task_group_id, item, count(*) AS nominations, round(avg(confidence), 6) AS mean_confidence FROM k GROUP BY 1, 2),
r AS (SELECT a.task_group_id, a.item, appearances, coalesce(nominations, 0) AS nominations, mean_confidence FROM a LEFT JOIN c USING (task_group_id, item))
SELECT *, row_number() OVER (PARTITION BY task_group_id ORDER BY nominations DESC, mean_confidence DESC NULLS LAST, item) AS place FROM r QUALIFY place <= 3"""
)
def nominated_finalists(spark: SparkSession, folder: str) -> DataFrame:
    """The three tasks of each group of two and more that were nominated most often, made-up calls nominating by a hash."""
    rows = _seats(spark, folder).withColumn("id", F.struct("task_group_id", "item"))
    digest = F.md5(F.concat_ws("/", "item", F.col("batch").cast("string")).cast("binary"))
    calls = rows.where(F.ascii(F.substring(digest, 1, 1)) % 3 == 0).select("batch", "id", F.ascii(F.substring(digest, 2, 1)).alias("confidence"))
    stats = experiments.nominations(rows.select("batch", "id"), calls, "batch", "id", "confidence").select("id.*", "appearances", "nominations", "mean_confidence")
    return ranking.quota_topk(stats, ["task_group_id"], [F.desc("nominations"), F.desc_nulls_last("mean_confidence"), F.asc("item")], 3)

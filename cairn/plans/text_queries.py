"""Queries on texts: normal forms, tokens, dates, duplicates, overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import similarity, text
from cairn.operators import ordered, overlap
from cairn.plans.catalog import query
from cairn.sources.tables import table

WORDS_SQL = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')"


@query(
    r"""SELECT case_id, trim(regexp_replace(lower(coalesce(query, '')), '[\s\p{Z}]+', ' ', 'g')) AS spaced,
       regexp_replace(trim(regexp_replace(lower(coalesce(query, '')), '[\s\p{Z}]+', ' ', 'g')), '^[ ?？!！。.,，]+|[ ?？!！。.,，]+$', '', 'g') AS query_key,
       regexp_replace(lower(coalesce(query, '')), '[^a-z0-9㐀-鿿]', '', 'g') AS alphanumeric,
       trim(regexp_replace(lower(translate(coalesce(query, ''), '：–—−‐‑', ':-----')), '[\s\p{Z}]+', ' ', 'g')) AS unified,
       substr(trim(regexp_replace(coalesce(query, ''), '[\s\p{Z}]+', ' ', 'g')), 1, 40) AS clipped FROM eval_prompts"""
)
def text_normal_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The normal forms of each test query."""
    q = F.col("query")
    return table(spark, folder, "eval_prompts").select("case_id", text.spaced(q).alias("spaced"), text.query_key(q).alias("query_key"), text.alphanumeric(q).alias("alphanumeric"), text.unified(q).alias("unified"), text.clipped(q, 40).alias("clipped"))


@query(
    """SELECT doc_id, CASE WHEN h + l = 0 THEN 'none' WHEN h * 4 >= (h + l) * 3 THEN 'cjk' WHEN l * 4 >= (h + l) * 3 THEN 'latin' ELSE 'mixed' END AS family
FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[㐀-鿿]')) AS h, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) AS l FROM documents)"""
)
def script_families(spark: SparkSession, folder: str) -> DataFrame:
    """Script family of each document."""
    return table(spark, folder, "documents").select("doc_id", text.script_family(F.col("text")).alias("family"))


STOPS_SQL = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
TERMS_SQL = f"""list_sort(list_filter(list_distinct(list_concat(regexp_extract_all(lower(coalesce(query, '')), '[a-z][a-z0-9_-]+'), regexp_extract_all(lower(coalesce(query, '')), '[㐀-鿿]{{2,}}'))), lambda x: x NOT IN ({STOPS_SQL})))"""


@query(f"SELECT case_id, array_to_string({TERMS_SQL}, ' ') AS terms FROM eval_prompts")
def query_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The terms that tell each test query apart."""
    return table(spark, folder, "eval_prompts").select("case_id", F.array_join(text.query_terms(F.col("query")), " ").alias("terms"))


@query(
    r"""WITH t AS (SELECT case_id, regexp_extract_all(lower(coalesce(query, '')), '[\p{L}\p{N}_]+') AS w, regexp_replace(lower(coalesce(query, '')), '[^a-z0-9㐀-鿿]', '', 'g') AS c FROM eval_prompts)
SELECT case_id, len(w) AS n_words, CASE WHEN len(w) >= 5 THEN len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) ELSE 0 END AS n_5grams,
       len(list_distinct(flatten(list_transform([2, 3, 4, 5, 6], lambda n: list_transform(range(1, greatest(length(c) - n + 2, 1)), lambda i: substr(c, i, n)))))) AS n_char_grams FROM t"""
)
def ngram_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of words, word 5-grams and character 2- to 6-grams of each test query."""
    w, c = text.words(F.col("query")), text.alphanumeric(F.col("query"))
    return table(spark, folder, "eval_prompts").select("case_id", F.size(w).alias("n_words"), F.size(similarity.ngrams(w, 5)).alias("n_5grams"), F.size(similarity.character_ngrams(c, 2, 6)).alias("n_char_grams"))


@query(
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, t, regexp_matches(t, '\b(20\d\d|19\d\d)-(\d{1,2})-(\d{1,2})\b') AS iso, regexp_matches(t, '(\d{4})年(\d{1,2})月(\d{1,2})日') AS zh,
 regexp_matches(t, '\b(\d{1,2}) (January|February|March|April|May|June|July|August|September|October|November|December) (\d{4})\b') AS en FROM d),
c AS (SELECT doc_id, t, CASE WHEN iso THEN regexp_extract(t, '\b(20\d\d|19\d\d)-(\d{1,2})-(\d{1,2})\b', 1) || '-' || lpad(regexp_extract(t, '\b(20\d\d|19\d\d)-(\d{1,2})-(\d{1,2})\b', 2), 2, '0') || '-' || lpad(regexp_extract(t, '\b(20\d\d|19\d\d)-(\d{1,2})-(\d{1,2})\b', 3), 2, '0')
 WHEN zh THEN regexp_extract(t, '(\d{4})年(\d{1,2})月(\d{1,2})日', 1) || '-' || lpad(regexp_extract(t, '(\d{4})年(\d{1,2})月(\d{1,2})日', 2), 2, '0') || '-' || lpad(regexp_extract(t, '(\d{4})年(\d{1,2})月(\d{1,2})日', 3), 2, '0')
 WHEN en THEN regexp_extract(t, '\b(\d{1,2}) (January|February|March|April|May|June|July|August|September|October|November|December) (\d{4})\b', 3) || '-' || lpad(CAST(list_position(['January','February','March','April','May','June','July','August','September','October','November','December'], regexp_extract(t, '\b(\d{1,2}) (January|February|March|April|May|June|July|August|September|October|November|December) (\d{4})\b', 2)) AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract(t, '\b(\d{1,2}) (January|February|March|April|May|June|July|August|September|October|November|December) (\d{4})\b', 1), 2, '0') END AS d FROM r)
SELECT doc_id, coalesce(strftime(TRY_CAST(d AS DATE), '%Y-%m-%d'), '') AS first_date, len(list_filter(list_distinct(regexp_extract_all(t, '\b(\d{4}-\d{2}-\d{2})\b', 1)), lambda x: TRY_CAST(x AS DATE) IS NOT NULL)) AS n_dates FROM c"""
)
def document_dates(spark: SparkSession, folder: str) -> DataFrame:
    """The first explicit date of each document and the number of distinct ISO dates."""
    return table(spark, folder, "documents").select("doc_id", text.explicit_date(F.col("text")).alias("first_date"), F.size(text.dates_in(F.col("text"))).alias("n_dates"))


@query(r"""SELECT doc_id, len(v) AS n_versions, coalesce(v[1], '') AS first_version FROM (SELECT doc_id, list_distinct(regexp_extract_all(coalesce(text, ''), '\b\d+(?:\.\d+){1,3}\b')) AS u, regexp_extract_all(coalesce(text, ''), '\b\d+(?:\.\d+){1,3}\b') AS a, list_filter(regexp_extract_all(coalesce(text, ''), '\b\d+(?:\.\d+){1,3}\b'), lambda x, i: list_position(a, x) = i) AS v FROM documents)""")
def document_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Version numbers that each document names."""
    v = text.versions(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.size(v).alias("n_versions"), F.coalesce(F.try_element_at(v, F.lit(1)), F.lit("")).alias("first_version"))


@query(
    """SELECT count(*) AS n, count(DISTINCT nullif(text, '')) AS n_distinct, round((count(*) - count(DISTINCT text)) / count(*), 6) AS duplicate_results, round((count(*) - count(DISTINCT nullif(text, ''))) / count(*), 6) AS duplicate_fragments FROM documents"""
)
def duplicate_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of repeated texts; for fragments empty ones count as repeats. Texts are compared by SHA-256."""
    digest = F.sha2("text", 256)
    rows = table(spark, folder, "documents").select(digest.alias("any"), F.when(F.col("text") != "", digest).alias("full"))
    out = rows.agg(F.count("*").alias("n"), F.countDistinct("any").alias("n_any"), F.countDistinct("full").alias("n_distinct"))
    return out.select("n", "n_distinct", F.round((F.col("n") - F.col("n_any")) / F.col("n"), 6).alias("duplicate_results"), F.round((F.col("n") - F.col("n_distinct")) / F.col("n"), 6).alias("duplicate_fragments"))


KEYWORDS = ("pipeline", "snapshot", "token", "检索器", "cookie")


@query(
    f"""WITH k AS (SELECT unnest([{", ".join(f"'{w}'" for w in KEYWORDS)}]) AS keyword), d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, keyword, CAST((length(t) - length(replace(t, keyword, ''))) / length(keyword) AS BIGINT) AS n, substr(t, greatest(instr(t, keyword) - 30, 1), instr(t, keyword) - greatest(instr(t, keyword) - 30, 1) + length(keyword) + 30) AS context
FROM d, k WHERE contains(t, keyword)"""
)
def keyword_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of a few keywords in each document, with the first in its context."""
    rows = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.lower("text").alias("t")).withColumn("keyword", F.explode(F.array(*[F.lit(w) for w in KEYWORDS])))
    hits = rows.where(F.contains("t", "keyword"))
    return hits.select("doc_id", "keyword", text.occurrences(F.col("t"), F.col("keyword")).alias("n"), text.around(F.col("t"), F.col("keyword"), 30).alias("context"))


@query(
    """WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), '^ | $', '', 'g') AS body FROM documents),
t AS (SELECT doc_id, string_split(body, ' ') AS w FROM b WHERE body <> '')
SELECT doc_id, i // 200 AS window_no, len(w[i + 1:i + 200]) AS n_tokens, md5(array_to_string(w[i + 1:i + 200], ' ')) AS digest FROM (SELECT doc_id, w, unnest(range(0, len(w), 200)) AS i FROM t)"""
)
def token_window_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed windows of two hundred white-space tokens of each document."""
    body = F.regexp_replace(F.regexp_replace("text", "[ \\t\\r\\n]+", " "), "^ | $", "")
    rows = table(spark, folder, "documents").select("doc_id", body.alias("body")).where("body <> ''").select("doc_id", F.posexplode(text.token_windows(F.split("body", " "), 200)).alias("window_no", "w"))
    return rows.select("doc_id", "window_no", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query(
    r"""WITH a AS (SELECT DISTINCT task_id, regexp_extract_all(lower(content.goal), '[\p{L}\p{N}_]+') AS w FROM training_tasks WHERE task_id IS NOT NULL),
b AS (SELECT DISTINCT case_id, regexp_extract_all(lower(query), '[\p{L}\p{N}_]+') AS w FROM eval_prompts WHERE case_id IS NOT NULL),
ga AS (SELECT DISTINCT task_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM a),
gb AS (SELECT DISTINCT case_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM b),
la AS (SELECT DISTINCT task_id, unnest(list_transform(range(1, greatest(len(w) - 11, 1)), lambda i: array_to_string(w[i:i+12], ' '))) AS g FROM a),
lb AS (SELECT DISTINCT case_id, unnest(list_transform(range(1, greatest(len(w) - 11, 1)), lambda i: array_to_string(w[i:i+12], ' '))) AS g FROM b),
na AS (SELECT task_id, count(*) AS n FROM ga GROUP BY 1), nb AS (SELECT case_id, count(*) AS n FROM gb GROUP BY 1),
s AS (SELECT task_id, case_id, count(*) AS n FROM ga JOIN gb USING (g) GROUP BY 1, 2), l AS (SELECT DISTINCT task_id, case_id FROM la JOIN lb USING (g))
SELECT s.task_id, s.case_id, round(s.n / (na.n + nb.n - s.n), 6) AS jaccard, l.task_id IS NOT NULL AS in_window FROM s JOIN na USING (task_id) JOIN nb USING (case_id) LEFT JOIN l ON l.task_id = s.task_id AND l.case_id = s.case_id"""
)
def goal_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Training goals and test queries that share a 5-gram, with their similarity and whether they share a 13-gram."""
    return overlap.ngram_overlap(table(spark, folder, "training_tasks").select("task_id", F.col("content.goal").alias("goal")), "task_id", "goal", table(spark, folder, "eval_prompts"), "case_id", "query")


@query(
    """WITH t AS (SELECT source_id, task_id, length(content) AS n FROM (SELECT DISTINCT source_id, task_id, content FROM sources) WHERE task_id IS NOT NULL AND content IS NOT NULL),
r AS (SELECT *, sum(n) OVER (PARTITION BY task_id ORDER BY source_id ROWS UNBOUNDED PRECEDING) AS used FROM t) SELECT source_id, task_id, CAST(used AS BIGINT) AS used FROM r WHERE used <= 1500"""
)
def budget_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """The first pages of each task whose contents fit a budget of characters together."""
    rows = table(spark, folder, "sources").select("source_id", "task_id", "content").distinct().where("task_id IS NOT NULL AND content IS NOT NULL").select("source_id", "task_id", F.length("content").alias("n"))
    return ordered.running(rows, ["task_id"], ["source_id"], {"used": ("sum", "n")}).where("used <= 1500").select("source_id", "task_id", "used")


@query(
    r"""WITH p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents)),
x AS (SELECT doc_id, w[i] AS word, i FROM p) SELECT doc_id, count(*) AS n_words, count(DISTINCT word) AS n_distinct, md5(string_agg(word, ' ' ORDER BY i)) AS digest FROM x GROUP BY doc_id"""
)
def inverted_index_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Each document rebuilt from its inverted index (word to positions) and digested; an index holds one document."""
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(text.words(F.col("text"))).alias("i", "word"))
    index = rows.groupBy("doc_id", "word").agg(F.collect_list("i").alias("places"))
    placed = index.groupBy("doc_id").agg(F.collect_list(F.struct("word", "places")).alias("index"))
    flat = F.flatten(F.transform("index", lambda e: F.transform(e["places"], lambda p: F.struct(p.alias("p"), e["word"].alias("w")))))
    body = F.array_join(F.transform(F.array_sort(flat), lambda s: s["w"]), " ")
    return placed.select("doc_id", F.size(flat).cast("bigint").alias("n_words"), F.size("index").cast("bigint").alias("n_distinct"), F.md5(body.cast("binary")).alias("digest"))


@query(
    r"""WITH l AS (SELECT doc_id, x AS line, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)),
k AS (SELECT doc_id, i, trim(regexp_replace(lower(line), '[\s\p{Z}]+', ' ', 'g')) AS key FROM l), f AS (SELECT doc_id, key, min(i) AS first, count(*) AS n FROM k WHERE key <> '' GROUP BY doc_id, key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(n) - count(*) AS BIGINT) AS n_repeated FROM f GROUP BY doc_id"""
)
def line_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct and repeated non-blank lines of each document; all within its row, without a shuffle."""
    keys = F.filter(F.transform(F.split("text", "\n"), lambda x: text.spaced(x)), lambda k: k != "")
    rows = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", keys.alias("k"))
    return rows.where(F.size("k") > 0).select("doc_id", F.size(F.array_distinct("k")).cast("bigint").alias("n_lines"), (F.size("k") - F.size(F.array_distinct("k"))).cast("bigint").alias("n_repeated"))


@query(
    """WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, j AS place, CAST(CASE WHEN n <= 5 THEN j ELSE round_even(j * (n - 1) / 4.0, 0) END AS BIGINT) AS line_index FROM (SELECT doc_id, n, unnest(range(0, least(n, 5))) AS j FROM n)"""
)
def evenly_spaced_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Up to five evenly spaced line numbers of each document, halves rounded to even."""
    rows = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    placed = rows.withColumn("place", F.explode(F.sequence(F.lit(0), F.least("n", F.lit(5)) - 1)))
    index = F.when(F.col("n") <= 5, F.col("place")).otherwise(F.bround(F.col("place") * (F.col("n") - 1) / 4.0, 0))
    return placed.select("doc_id", F.col("place").cast("bigint").alias("place"), index.cast("bigint").alias("line_index"))


@query(
    """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, i FROM l WHERE contains(lower(line), 'snapshot')) SELECT DISTINCT l.doc_id, l.i AS line_no, md5(l.line) AS digest FROM l JOIN h ON l.doc_id = h.doc_id AND abs(l.i - h.i) <= 1"""
)
def neighbour_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines next to a hit: the band condition is an equi-join on unfolded neighbours."""
    lines = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("bigint").alias("line_no"), "line")
    near = lines.where(F.lower("line").contains("snapshot")).select("doc_id", F.explode(F.sequence(F.col("line_no") - 1, F.col("line_no") + 1)).alias("line_no")).distinct()
    return lines.join(near, ["doc_id", "line_no"], "left_semi").select("doc_id", "line_no", F.md5(F.col("line").cast("binary")).alias("digest"))

"""Queries that split, clean and search texts page by page; tested against small fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import passages
from cairn.plans.catalog import query
from cairn.sources.tables import table


@query()
def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every document."""
    return passages.sentence_rows(table(spark, folder, "documents").select("doc_id", "text"), "text")


@query()
def chunk_semantic(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in chunks of paragraphs."""
    return passages.chunk_rows(table(spark, folder, "documents").select("doc_id", "text"), "text", limit=200)


@query()
def page_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as one chunk if it is short, else in chunks of paragraphs."""
    return passages.page_chunk_rows(table(spark, folder, "documents").select("doc_id", "text"), "text", 300, 200)


@query(
    r"""WITH RECURSIVE d AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents WHERE coalesce(text, '') <> ''), s AS (SELECT doc_id, regexp_extract_all(t, '[^\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]*[\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]|[^\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]+$') AS ls FROM d),
z AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS x FROM s),
c AS (SELECT doc_id, i, i AS first, length(x) AS size FROM z WHERE i = 1 UNION ALL SELECT z.doc_id, z.i, CASE WHEN c.size + length(z.x) > 2000 THEN z.i ELSE c.first END, CASE WHEN c.size + length(z.x) > 2000 THEN length(z.x) ELSE c.size + length(z.x) END FROM c JOIN z ON z.doc_id = c.doc_id AND z.i = c.i + 1),
g AS (SELECT doc_id, first AS a, max(i) AS b FROM c GROUP BY 1, 2), o AS (SELECT *, row_number() OVER w - 1 AS place, lag(a) OVER w AS before FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY a)), f AS (SELECT doc_id, place, CASE WHEN before IS NULL THEN a ELSE greatest(before, a - 2) END AS first_line, b AS last_line FROM o)
SELECT f.doc_id, f.place, f.first_line, f.last_line, string_agg(z.x, '' ORDER BY z.i) AS chunk, CAST(NULL AS VARCHAR) AS problem FROM f JOIN z ON z.doc_id = f.doc_id AND z.i BETWEEN f.first_line AND f.last_line GROUP BY 1, 2, 3, 4"""
)
def chunk_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in chunks of lines, with two lines of overlap."""
    return passages.line_chunk_rows(table(spark, folder, "documents").select("doc_id", "text"), "text", 2000, 2)


@query()
def hard_literals(spark: SparkSession, folder: str) -> DataFrame:
    """The typed literals of every page."""
    return passages.literal_rows(table(spark, folder, "sources").select("source_id", "content").distinct(), "content")


@query()
def untrusted_literals(spark: SparkSession, folder: str) -> DataFrame:
    """Literals in a task's goal that none of its pages has."""
    goals = table(spark, folder, "training_tasks").select("task_id", F.col("content.goal").alias("goal"))
    pages = table(spark, folder, "sources").where("task_id IS NOT NULL").select("task_id", "content").distinct()
    return passages.untrusted_literals(passages.literal_rows(goals, "goal"), passages.literal_rows(pages, "content"), "task_id")


@query()
def quote_grounding(spark: SparkSession, folder: str) -> DataFrame:
    """Where each snippet stands in the page's excerpt."""
    rows = table(spark, folder, "evidence_items").select("item_id", F.col("snippet").alias("quote"), "page_excerpt").distinct()
    return passages.quote_rows(rows, "page_excerpt", "quote")


@query()
def html_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as Markdown: the blocks of scans that are HTML, and every retrieved page set into HTML with navigation around its text."""
    blocks = table(spark, folder, "page_blocks").where("block_content LIKE '<%'").select(F.concat_ws("/", "scan_id", "page_index", "block_id").alias("page_id"), F.col("block_content").alias("html"), F.lit("").alias("base"))
    text = F.replace(F.replace(F.coalesce("content", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    paragraphs = F.array_join(F.transform(F.split(text, "\n"), lambda line: F.concat(F.lit("<p>"), line, F.lit("</p>"))), "")
    page = F.concat(F.lit("<html><body><nav><a href='/'>Home</a></nav><main><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1>"), paragraphs, F.lit("</main><footer>Imprint</footer></body></html>"))
    pages = table(spark, folder, "sources").select(F.col("source_id").alias("page_id"), page.alias("html"), F.coalesce("url", F.lit("")).alias("base"))
    return passages.page_rows(blocks.unionByName(pages).distinct(), "html", "base").drop("links", "place")


@query()
def clean_page_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Both excerpts of every item without navigation lines, by rules."""
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("excerpt")) for c in ("page_excerpt", "source_excerpt")])).alias("f")
    rows = table(spark, folder, "evidence_items").select("item_id", fields).select("item_id", "f.*").distinct()
    return passages.cleaned_rows(rows, "excerpt").drop("place")

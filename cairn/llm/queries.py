"""Registered queries of the training-text operators; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import boilerplate, contamination, mixing, scans, shared_spans, splitting, tokenizer
from cairn.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _corpora(spark: SparkSession, folder: str) -> dict[str, tuple[DataFrame, str, str]]:
    tasks = table(spark, folder, "training_tasks").select("task_id", F.col("content.goal").alias("goal"))
    return {"documents": (table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text"), "training_tasks": (tasks, "task_id", "goal")}


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    cases = table(spark, folder, "eval_prompts")
    found = [contamination.find_leaks(df, key, text, cases).select(F.lit(name).alias("corpus"), "*") for name, (df, key, text) in _corpora(spark, folder).items()]
    return found[0].unionByName(found[1])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus records and the test items that leaked into them."""
    return _leaks(spark, folder).select("corpus", "record_id", "case_id")


def p1_spans(spark: SparkSession, folder: str) -> DataFrame:
    """For each found pair its longest verbatim match and where it stands."""
    return _leaks(spark, folder)


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of the documents into which no test item leaked."""
    df, key, text = _corpora(spark, folder)["documents"]
    return contamination.without_leaks(df.select(key), key, contamination.find_leaks(df, key, text, table(spark, folder, "eval_prompts")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that are page furniture, divide a word, hold misread words, or end a block in mid-paragraph."""
    return scans.repairs_found(table(spark, folder, "page_blocks"))


def p2_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The repaired text of every scan, paragraph by paragraph."""
    return scans.paragraphs(table(spark, folder, "page_blocks"))


def _split(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    return splitting.split_texts(table(spark, folder, "material_texts"), "text_id", "text", "max_chars", "overlap_lines", **options)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts over their limit, with a line over it, or with a run over it that has no natural boundary."""
    return splitting.size_kinds(_split(spark, folder, with_text=False), "text_id")


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every text."""
    return splitting.piece_rows(_split(spark, folder), "text_id")


def _boilerplate(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.find_boilerplate(table(spark, folder, "evidence_items"), "item_id", "title", ["page_excerpt", "source_excerpt"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each excerpt that hold nothing of the page's main body."""
    return boilerplate.boilerplate_lines(_boilerplate(spark, folder), "item_id")


def p5_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The main body of each excerpt."""
    return _boilerplate(spark, folder).select("item_id", "field", "body").distinct()


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode_texts(table(spark, folder, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sized = tokenizer.count_tokens(table(spark, folder, "documents").select("doc_id", "source", "text"), "text")
    return mixing.mix_sources(sized, "doc_id", "source", "n_tokens", table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen documents and how often each occurs."""
    return _mix(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of all tokens that each source reaches."""
    return _mix(spark, folder)[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Longest stretches of each document that also stand in another one."""
    return shared_spans.shared_spans(table(spark, folder, "documents"), "doc_id", "text")


def p8_share(spark: SparkSession, folder: str) -> DataFrame:
    """For each document, how many of its characters stand in another one."""
    return shared_spans.shared_share(table(spark, folder, "documents"), "doc_id", "text", p8_found(spark, folder))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_spans, p1_clean, p2_found, p2_paragraphs, p4_found, p4_pieces, p5_found, p5_bodies, p6_ids, p7_mix, p7_shares, p8_found, p8_share)}


#: Lengths after CR LF and lone CR became LF; runs are what lies between white space and stops.
P4_SQL = """
WITH t AS (SELECT text_id, max_chars, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS body
           FROM material_texts WHERE text IS NOT NULL AND max_chars > 0),
     k AS (SELECT text_id, max_chars, length(body) AS size, list_max(list_transform(string_split(body, chr(10)), lambda x: length(x))) AS line,
                  list_max(list_transform(regexp_split_to_array(body, '[\\s\\x{85}\\p{Z}.!?;。！？；]'), lambda x: length(x))) AS run FROM t)
SELECT DISTINCT text_id, 'oversized' AS kind FROM k WHERE size > max_chars
UNION SELECT DISTINCT text_id, 'long_line' FROM k WHERE line > max_chars
UNION SELECT DISTINCT text_id, 'long_run' FROM k WHERE run > max_chars
"""


#: Hashes of all windows of 320 characters, cut from pieces of the texts; windows of two documents, and the stretches they make.
P8_SPANS = """d AS (SELECT DISTINCT doc_id, text, length(text) AS n FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 320), b AS (SELECT doc_id, n, text, unnest(range(0, n - 319, 500)) AS at0 FROM d),
p AS (SELECT doc_id, n, at0, substr(text, CAST(at0 AS INT) + 1, 819) AS piece FROM b), w AS (SELECT doc_id, at0, piece, unnest(range(0, least(500, n - 319 - at0))) AS i FROM p), h AS (SELECT doc_id, at0 + i AS s, hash(substr(piece, CAST(i AS INT) + 1, 320)) AS h FROM w),
g AS (SELECT h FROM h GROUP BY h HAVING min(doc_id) <> max(doc_id)), r AS (SELECT DISTINCT doc_id, s FROM h JOIN g USING (h)), f AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER w + 320 THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
k AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS part FROM f), spans AS (SELECT doc_id, min(s) AS start_char, max(s) + 320 AS end_char FROM k GROUP BY doc_id, part)"""
P8_SHARE_SQL = f"""WITH {P8_SPANS}, o AS (SELECT doc_id, CAST(sum(end_char - start_char) AS BIGINT) AS shared_chars FROM spans GROUP BY 1)
SELECT c.doc_id, coalesce(length(c.text), 0) AS n_chars, coalesce(o.shared_chars, 0) AS shared_chars, CASE WHEN coalesce(length(c.text), 0) > 0 THEN coalesce(o.shared_chars, 0) / length(c.text) END AS share FROM documents c LEFT JOIN o USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL, "p8_found": f"WITH {P8_SPANS} SELECT doc_id, start_char, end_char FROM spans", "p8_share": P8_SHARE_SQL}

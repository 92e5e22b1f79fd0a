"""Passage operators: plain functions of one text, run over Arrow batches in one narrow stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from cairn.functions import html, passages
from cairn.operators import skew


def each_text(df: DataFrame, columns: list[str], function: Callable[..., list[dict]], schema: str) -> DataFrame:
    """For each row all rows of ``function`` (of the text columns' values), with ``place`` from 0 and the row's other columns.

    A function sees one row at a time, nulls included. Columns of ``schema`` replace others of the same name.
    """
    made = StructType.fromDDL(schema)
    rest = [c for c in df.columns if c not in columns and c not in made.names and c != "place"]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row") if rest else F.struct(F.lit(0).alias("none")).alias("row"), *[F.col(c) for c in columns])
    kind = rows.schema["row"].dataType.simpleString()
    arrow = pa.struct([(f.name, to_arrow_type(f.dataType)) for f in made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                which, place, out = [], [], []
                for i, values in enumerate(zip(*[part.column(1 + c).to_pylist() for c in range(len(columns))], strict=True)):
                    for n, row in enumerate(function(*values)):
                        which.append(i)
                        place.append(n)
                        out.append(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which, pa.int64())), pa.array(place, pa.int32()), pa.array(out, arrow)], ["row", "place", "out"])

    done = skew.dealt(rows).mapInArrow(run, f"row {kind}, place int, out {made.simpleString()}")
    return done.select(*[F.col("row").getField(c).alias(c) for c in rest], "place", *[F.col("out").getField(n).alias(n) for n in made.names])


def sentence_rows(df: DataFrame, text: str) -> DataFrame:
    """A row for each sentence."""
    return each_text(df, [text], lambda t: [{"sentence": s} for s in passages.sentences(t)], "sentence string")


def chunk_rows(df: DataFrame, text: str, limit: int = 800, overlap: float = 0.1) -> DataFrame:
    """A row for each chunk of paragraphs."""
    return each_text(df, [text], lambda t: [{"chunk": c, "n_tokens": passages.word_count(c)} for c in passages.chunks(t, limit, overlap)], "chunk string, n_tokens int")


def page_chunk_rows(df: DataFrame, text: str, whole: int = 2400, limit: int = 800, overlap: float = 0.1) -> DataFrame:
    """A row for each chunk of a page, with its id: one for a page of at most ``whole`` tokens, else chunks of paragraphs, overlapping by at most a quarter. Blank pages have none."""

    def cut(t: str | None) -> list[dict]:
        body = (t or "").strip()
        n = passages.word_count(body)
        parts = [body] if body and n <= whole else passages.chunks(body, limit, max(0.0, min(overlap, 0.25)))
        return [{"chunk_id": f"chunk-{i}", "chunk": c, "n_tokens": passages.word_count(c)} for i, c in enumerate(parts, 1)]

    return each_text(df, [text], cut, "chunk_id string, chunk string, n_tokens int")


def line_chunk_rows(df: DataFrame, text: str, limit: int, overlap_lines: int) -> DataFrame:
    """A row for each chunk of lines; a text with a line over the limit gives one row with its ``problem``."""

    def cut(t: str | None) -> list[dict]:
        try:
            return [{"first_line": a, "last_line": b, "chunk": c, "problem": None} for a, b, c in passages.line_chunks(t, limit, overlap_lines)]
        except ValueError as e:
            return [{"first_line": None, "last_line": None, "chunk": None, "problem": str(e)}]

    return each_text(df, [text], cut, "first_line int, last_line int, chunk string, problem string")


def literal_rows(df: DataFrame, text: str) -> DataFrame:
    """A row for each typed literal."""
    names = ("kind", "value", "surface", "start_char", "end_char")
    return each_text(df, [text], lambda t: [dict(zip(names, r, strict=True)) for r in passages.literals(t)], "kind string, value string, surface string, start_char int, end_char int")


def untrusted_literals(claims: DataFrame, sources: DataFrame, by: str) -> DataFrame:
    """Literals of claims that none of the sources of the same ``by`` has; a full date of a source vouches for its year too."""
    known = sources.select(by, "kind", "value")
    years = sources.where("kind = 'date'").select(by, F.lit("year").alias("kind"), F.substring("value", 1, 4).alias("value"))
    return claims.join(known.unionByName(years).distinct(), [by, "kind", "value"], "left_anti")


def quote_rows(df: DataFrame, source: str, quote: str) -> DataFrame:
    """Where each quote stands in its source; ``basis`` is null if it can't be found."""

    def find(s: str | None, q: str | None) -> list[dict]:
        hit = passages.locate_quote(s, q)
        return [{"start_char": hit[0], "end_char": hit[1], "basis": hit[2]} if hit else {"start_char": None, "end_char": None, "basis": None}]

    return each_text(df, [source, quote], find, "start_char int, end_char int, basis string")


def page_rows(df: DataFrame, page: str, base: str) -> DataFrame:
    """Title, Markdown, dates and links of each HTML page."""
    schema = "title string, markdown string, description string, published string, modified string, quality double, links array<struct<url: string, text: string>>"
    return each_text(df, [page, base], lambda h, u: [(p := html.read_page(h, u or "")) | {"links": [{"url": a, "text": b} for a, b in p["links"]]}], schema)


def cleaned_rows(df: DataFrame, text: str) -> DataFrame:
    """Page text without navigation lines, with counts."""
    return each_text(df, [text], lambda t: [html.clean_lines(t)], "text string, raw_chars int, clean_chars int, content_lines int, navigation_lines int, picture_lines int, navigation_ratio double")


def decoded_rows(df: DataFrame, data: str, declared: str) -> DataFrame:
    """Binary pages decoded to text."""
    return each_text(df, [data, declared], lambda b, c: [{"text": passages.decoded(b, c)}], "text string")

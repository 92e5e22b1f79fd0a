"""Reading and writing JSON lines, prompt files, text files of unknown encoding, and partitioned exports."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from cairn.operators import passages

#: Names under which a prompt and its id may stand, in order of preference.
PROMPT_NAMES = ("query", "question", "prompt", "instruction")
ID_NAMES = ("case_id", "id")
WRAPPERS = ("cases", "tasks", "data")


def read_json_lines(spark: SparkSession, path: str, schema: str | StructType, strict: bool = True) -> DataFrame:
    """JSON lines with a given schema. A line that is no object of it raises when read; with ``strict=False`` it is skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_text_files(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """(path, text) of whole text files below ``path``, each decoded by whichever encoding reads it best."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return passages.decoded_rows(files.select("path", "content", F.lit(None).cast("string").alias("declared")), "content", "declared").drop("place")


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of the files below ``root``; a pattern that climbs out of it is refused."""
    if ".." in pattern.split("/") or pattern.startswith("/"):
        raise ValueError(f"{pattern!r} leads out of the folder")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def confined(root: str, path: str) -> str:
    """``path`` below ``root``; ValueError if it leads out of it."""
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, path))
    if full != base and not full.startswith(base + os.sep):
        raise ValueError(f"{path!r} leads out of the folder")
    return full


def _first(df: DataFrame, names: tuple[str, ...]) -> Column:
    have = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def _unwrapped(df: DataFrame) -> DataFrame:
    for name in WRAPPERS:
        if name in df.columns and isinstance(df.schema[name].dataType, ArrayType):
            inner = df.where(F.col(name).isNotNull()).select(F.explode(name).alias("r"))
            return inner.select("r.*") if isinstance(df.schema[name].dataType.elementType, StructType) else inner
    return df


def read_prompts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(id, prompt, origin) of files of test items: JSON lines, or JSON with the items under a wrapper key.

    The prompt is the first non-empty of PROMPT_NAMES, the id of ID_NAMES, else file name and position. Items
    without a prompt are left out; so are lines that are no JSON objects.
    """
    out = None
    for path in paths:
        raw = spark.read.option("multiLine", str(not path.endswith((".jsonl", ".ndjson"))).lower()).option("mode", "DROPMALFORMED").json(path)
        rows = _unwrapped(raw)
        stem = os.path.splitext(os.path.basename(path))[0]
        own = F.concat(F.lit(stem + ":"), F.monotonically_increasing_id())
        one = rows.select(F.coalesce(_first(rows, ID_NAMES), own).alias("id"), _first(rows, PROMPT_NAMES).alias("prompt"), F.lit(stem).alias("origin")).where("prompt IS NOT NULL")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "id string, prompt string, origin string")
    return out


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(id, answer, status) of a file of runs: JSON with the rows under ``results`` or ``cases``, or JSON lines.

    The id is the first non-empty of id, benchmark_id and case_id, the answer that of answer and final_output, else ''.
    """
    raw = spark.read.option("multiLine", str(not path.endswith((".jsonl", ".ndjson"))).lower()).option("mode", "DROPMALFORMED").json(path)
    name = next((n for n in ("results", "cases") if n in raw.columns), None)
    rows = raw.where(F.col(name).isNotNull()).select(F.explode(name).alias("r")).select("r.*") if name else raw
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in rows.columns], F.lit(None).cast("string"))
    return rows.select(first("id", "benchmark_id", "case_id").alias("id"), F.coalesce(first("answer", "final_output"), F.lit("")).alias("answer"), first("status").alias("status"))


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Adds rows to a JSON-lines dataset; ValueError if one of their keys is null, repeated or already there."""
    spark = df.sparkSession
    bad = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n").cast("int").isNull() | (F.col("n") > 1) | F.col(key).isNull())
    if not bad.isEmpty():
        raise ValueError(f"null or repeated {key}")
    present = spark._jvm.org.apache.hadoop.fs.Path(path)
    if present.getFileSystem(spark._jsc.hadoopConfiguration()).exists(present):
        old = spark.read.schema(StructType().add(key, StringType())).json(path)
        if not df.select(F.col(key).cast("string")).join(old, key, "left_semi").isEmpty():
            raise ValueError(f"a {key} is already in the dataset")
    df.write.mode("append").json(path)


def export_lanes(lanes: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each table as JSON lines below ``path`` and returns (and writes) the manifest: lane, rows, content hash.

    The hash adds the rows' SHA-256 prefixes, so it depends on the rows but neither on their order nor on how
    they are spread over files.
    """
    manifest = None
    for name, df in lanes.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
        spark = df.sparkSession
        lines = spark.read.text(f"{path}/{name}")
        part = F.conv(F.substring(F.sha2("value", 256), 1, 12), 16, 10).cast("decimal(38,0)")
        one = lines.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("content_hash")).select(F.lit(name).alias("lane"), "rows", "content_hash")
        manifest = one if manifest is None else manifest.unionByName(one)
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def export_audit(df: DataFrame, key: str, path: str) -> DataFrame:
    """Writes a folder of JSON for each key below ``path`` and returns (and writes) the index: key, rows, content hash, in no order.

    Rows are brought together by key before they are written, so that a key's rows lie in few files. Null keys are left out.
    """
    rows = df.where(F.col(key).isNotNull())
    rows.withColumn("part", F.col(key)).repartition("part").write.mode("overwrite").partitionBy("part").json(f"{path}/cases")
    part = F.conv(F.substring(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    index = rows.groupBy(key).agg(F.count("*").alias("rows"), F.sum(part).cast("string").alias("content_hash"))
    index.write.mode("overwrite").json(f"{path}/index")
    return index

import json

import pytest
from cairn import catalog
from cairn.operators.validation import Rules, staleness
from cairn.sources import files
from cairn.streaming import events as S
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.read_json_lines(spark, str(path), "a int", strict=False).collect()) == [1, 2]
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.read_json_lines(spark, str(path), "a int").collect()


def test_prompts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"cases": [{"case_id": "1", "question": " one "}, {"id": "2", "query": "", "prompt": "two"}, {"id": "3"}]}))
    (tmp_path / "b.jsonl").write_text('{"instruction": "three"}\n')
    got = files.read_prompts(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.jsonl")]).collect()
    assert {(r["id"], r["prompt"]) for r in got} == {("1", "one"), ("2", "two"), ("b:0", "three")}
    assert files.read_prompts(spark, []).count() == 0


def test_text_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_bytes("中文".encode("gb18030"))
    (tmp_path / "b.md").write_text("plain")
    (tmp_path / "c.bin").write_text("no")
    assert sorted(r["text"] for r in files.read_text_files(spark, str(tmp_path)).collect()) == ["plain", "中文"]
    assert files.list_files(spark, str(tmp_path)).count() == 3
    with pytest.raises(ValueError):
        files.list_files(spark, str(tmp_path), "../*")
    with pytest.raises(ValueError):
        files.confined(str(tmp_path), "../x")
    assert files.confined(str(tmp_path), "sub/a.txt").endswith("a.txt")


def test_append_and_export(spark, tmp_path):
    path = str(tmp_path / "set")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    files.append_new(df, path, "id")
    files.append_new(spark.createDataFrame([("c", 3)], "id string, v int"), path, "id")
    for bad in ([("a", 9)], [("d", 1), ("d", 2)], [(None, 1)]):
        with pytest.raises(ValueError):
            files.append_new(spark.createDataFrame(bad, "id string, v int"), path, "id")
    assert spark.read.json(path).count() == 3
    lanes = {"x": df, "y": df.where("false")}
    one = {r["lane"]: (r["rows"], r["content_hash"]) for r in files.export_lanes(lanes, str(tmp_path / "out")).collect()}
    two = {r["lane"]: (r["rows"], r["content_hash"]) for r in files.export_lanes({"x": df.repartition(3).orderBy(F.desc("id")), "y": df.where("false")}, str(tmp_path / "out2")).collect()}
    assert one == two and one["x"][0] == 2 and one["y"] == (0, "0")


def test_rules(spark):
    rows = spark.createDataFrame([("a", 1, "t1"), ("b", None, "t9"), ("c", 3, None), ("c", 4, "t1"), (None, 1, "t1")], "id string, v int, task string")
    tasks = spark.createDataFrame([("t1",)], "task_id string")
    rules = Rules("id").row("no_value", F.col("v").isNull()).unique("repeated", ["id"]).refers("no_task", "task", tasks, "task_id").row("large", F.col("v") > 3, "warning")
    assert {tuple(r) for r in rules.issues(rows).collect()} == {("b", "no_value", "error"), ("b", "no_task", "error"), ("c", "repeated", "error"), ("c", "large", "warning")}
    assert [r["id"] for r in rules.accepted(rows).collect()] == ["a"]
    assert Rules("id").issues(rows).count() == 0
    day = lambda s: F.lit(s).cast("date")
    got = spark.range(1).select(*[staleness(F.lit(None), F.lit(r), c, F.lit(10), day("2025-01-31")) for r, c in (("", day("2025-01-30")), ("x", F.lit(None).cast("date")), ("x", day("2025-01-01")), ("x", day("2025-01-30")))]).first()
    assert list(got) == ["pending", "invalid", "stale", "ready"]


def test_sql_functions(spark):
    assert "cairn_sentences" in catalog.register(spark)
    assert spark.sql("SELECT cairn_sentences('One. Two.') AS s, cairn_word_count('a b 中') AS n").first() == (["One.", "Two."], 3)


def run(stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    path = str(tmp_path / "events")
    schema = "seq bigint, ts timestamp, kind string, text string"
    rows = [(i, f"2025-01-01 00:{i:02d}:00", "ab"[i % 2], "x" * (i % 5) or None) for i in range(30)]
    df = spark.createDataFrame(rows, "seq bigint, ts string, kind string, text string").withColumn("ts", F.to_timestamp("ts"))
    for part in (df.where("seq < 15"), df.where("seq >= 15"), df.where("seq < 5")):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = lambda: S.tail(spark, path, spark.createDataFrame([], schema).schema, 1)
    last = {}
    for r in run(S.ledger(stream(), "kind", "seq", "text"), "update", "ledger"):
        if r["n"] > last.get(r["key"], (0,) * 4)[3]:
            last[r["key"]] = (r["text"], r["first_seq"], r["last_seq"], r["n"])
    assert last == {"a": ("xxxx", 0, 28, 18), "b": ("xxxx", 1, 29, 17)}
    assert len(run(S.first_seen(stream(), "ts", ["seq"], "2 hours"), "append", "fresh")) == 30
    windows = run(S.throughput(stream(), "ts", "kind", "seq", late="2 hours"), "complete", "windows")
    assert max(r["n"] for r in windows) == 11


def test_runs_of_three_layouts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"results": [{"id": "1", "answer": "x", "status": "completed"}, {"benchmark_id": "2", "final_output": "y"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"cases": [{"case_id": "3", "answer": ""}]}))
    (tmp_path / "c.jsonl").write_text('{"id": "4", "answer": "z"}\nbroken\n')
    got = {tuple(r) for n in ("a.json", "b.json", "c.jsonl") for r in files.read_runs(spark, str(tmp_path / n)).collect()}
    assert got == {("1", "x", "completed"), ("2", "y", None), ("3", "", None), ("4", "z", None)}


def test_audit_export(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "case string, n int")
    index = files.export_audit(df, "case", str(tmp_path / "audit"))
    assert {(r["case"], r["rows"]) for r in index.collect()} == {("a", 2), ("b", 1)}
    back = spark.read.json(str(tmp_path / "audit/cases"))
    assert {(r["part"], r["n"]) for r in back.collect()} == {("a", 1), ("a", 2), ("b", 3)}

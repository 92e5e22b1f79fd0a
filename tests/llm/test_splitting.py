import random
import re

from cairn.llm import splitting as P


def kinds(text, most):
    if not text or not most or most < 1:
        return set()
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    out = {"oversized"} if len(t) > most else set()
    if max(map(len, t.split("\n"))) > most:
        out.add("long_line")
    if max(map(len, re.split(r"[\s.!?;。！？；]", t))) > most:
        out.add("long_run")
    return out


def texts(seed, n):
    r = random.Random(seed)
    parts = ["word", "longerword", " ", " ", ". ", "! ", "。", "；", "\n", "\n\n", "\r\n", "\r", "中文字", "x" * 30, '." ', "　", "1.5", "\t"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 120))) for _ in range(n)]


def test_pieces_and_kinds(spark):
    r = random.Random(1)
    rows = [(i, t, r.choice([None, 0, 1, 5, 20, 64, 300]), r.choice([None, -1, 0, 1, 2, 9]), "extra") for i, t in enumerate(texts(3, 300))]
    rows += [(1000, None, 10, 1, ""), (1001, "", 10, 1, ""), (1002, "   \n \n  ", 3, 1, ""), (1003, "y" * 1000, 7, 2, ""), rows[0], (None, "a b c d e f", 3, 0, "")]
    df = spark.createDataFrame(rows, "text_id bigint, text string, max_chars int, overlap_lines int, pieces string")
    split = P.split_texts(df, "text_id", "text", "max_chars", "overlap_lines")
    found = [tuple(x) for x in P.size_kinds(split, "text_id").collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(i, k) for i, t, m, _, _ in rows for k in kinds(t, m) if i is not None}
    by = {x["text_id"]: x["pieces"] for x in split.collect()}
    for i, t, most, overlap, _ in rows:
        t = (t or "").replace("\r\n", "\n").replace("\r", "\n")
        got = by[i]
        if not t:
            assert got == []
            continue
        assert all(p["text"] == t[p["start_char"] : p["end_char"]] for p in got)
        assert got[0]["start_char"] == 0 and got[-1]["end_char"] == len(t)
        if most and most > 0:
            assert all(0 < len(p["text"]) <= most for p in got)
        for a, b in zip(got, got[1:], strict=False):
            assert a["start_char"] < b["start_char"] <= a["end_char"] < b["end_char"]
            shared = t[b["start_char"] : a["end_char"]]
            assert b["overlap_lines"] <= max(0, overlap or 0)
            assert len(shared.splitlines()) == b["overlap_lines"] or not shared.strip()
            if shared:
                assert t[b["start_char"] - 1] == "\n"


def test_natural_boundaries_come_first(spark):
    text = "First paragraph here.\nStill first.\n\nSecond one is here. It goes on and on.\nLast line"
    df = spark.createDataFrame([(1, text, 40, 1)], "text_id bigint, text string, max_chars int, overlap_lines int")
    got = P.piece_rows(P.split_texts(df, "text_id", "text", "max_chars", "overlap_lines"), "text_id").orderBy("piece_no").collect()
    assert [p["cut"] for p in got][0] == "paragraph" and "hard" not in {p["cut"] for p in got}
    assert got[0]["text"] == "First paragraph here.\nStill first.\n\n"


def test_limits_in_tokens(spark):
    text = "one two three four five six. " * 40 + "数据" * 50
    df = spark.createDataFrame([(1, text, 30, 0)], "text_id bigint, text string, max_tokens int, overlap_lines int")
    got = P.split_texts(df, "text_id", "text", "max_tokens", "overlap_lines", unit="tokens").first()["pieces"]
    assert "".join(p["text"] for p in got) == text and all(p["size"] <= 30 for p in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "text_id bigint, text string, max_chars int, overlap_lines int")
    assert P.split_texts(df, "text_id", "text", "max_chars", "overlap_lines").count() == 0


def test_overlap_of_more_than_half_a_piece(spark):
    lines = [f"line {i:02d} has thirty characters\n" for i in range(12)]
    text = "".join(lines)
    df = spark.createDataFrame([(1, text, 100, 2), (2, text, 100, 9), (3, "a" * 59 + "\n" + "b" * 30 + "\n" + "c" * 60, 100, 1)], "text_id bigint, text string, max_chars int, overlap_lines int")
    by = {x["text_id"]: x["pieces"] for x in P.split_texts(df, "text_id", "text", "max_chars", "overlap_lines").collect()}
    assert all(len(p["text"]) <= 100 for x in by.values() for p in x)
    assert [p["overlap_lines"] for p in by[1]] == [0] + [2] * (len(by[1]) - 1) and len(by[1]) > 2
    assert all(p["overlap_lines"] >= 2 for p in by[2][1:])
    assert not {"hard"} & {p["cut"] for x in by.values() for p in x}

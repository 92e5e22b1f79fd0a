import random

import pytest
from cairn.llm import scans as S

WORDS = "planner measures every window before report written threshold deliberately documented authoritative conservative migration pipeline multilingual retriever snapshot".split()


def test_distance_prefers_lookalikes():
    for read, true in (("documerited", "documented"), ("thresbold", "threshold"), ("approxirnates", "approximates"), ("rebui1t", "rebuilt"), ("dociiments", "documents"), ("baselme", "baseline"), ("conﬁrms", "confirms"), ("recoverecl", "recovered"), ("withdravvn", "withdrawn")):
        assert S.distance(read, true) == pytest.approx(S.NEAR), (read, true)
    assert S.distance("c0nf1rms", "confirms") == pytest.approx(2 * S.NEAR)
    assert S.distance("merge", "merges") > S.MOST and S.distance("tables", "cables") > S.MOST


def test_numbers():
    for read, true in (("2O22", "2022"), ("66B2", "6682"), ("7.l3.0", "7.13.0"), ("93S", "935"), ("l999", "1999")):
        assert S.number_repair(read) == true
    for word in ("2022", "planner", "loss", "v2", "is", "1st", "lO"):
        assert S.number_repair(word) is None


def test_furniture():
    for line in ("- 192 -", "[447]", "Page 2 of 5", "vi", "9l9", "第 3 页"):
        assert S.is_furniture(line, True, False) and not S.is_furniture("12 windows", True, True)
    assert S.is_furniture("Bulletin of Windows    Page 2 of 5", False, False)
    assert S.is_furniture("[203]    How the planner measures wi", False, True)
    assert not S.is_furniture("2022", False, False)


def book(seed=1):
    r = random.Random(seed)
    rows = []
    for scan in range(12):
        for page in range(3):
            body = [" ".join(r.choice(WORDS) for _ in range(6)) for _ in range(8)]
            body[-1] += "."
            rows += [(f"s{scan}", page, 0, f"Page {page + 1} of 3    On planners"), (f"s{scan}", page, 1, "\n".join(body)), (f"s{scan}", page, 2, f"[{page + 7}]")]
    return rows


def found(spark, rows):
    df = spark.createDataFrame([(*x, "text", "w") for x in rows], "scan_id string, page_index int, block_id int, block_content string, block_label string, word string")
    out = [tuple(r) for r in S.repairs_found(df).collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_all_kinds(spark):
    rows = book()
    rows += [
        ("t", 0, 0, "Bulletin    12"),
        ("t", 0, 1, "The autboritative planner measures 2O22 windows delib-\nerately. The multi-\nlingual snapshot was docu\xad"),
        ("t", 0, 2, "Figure 3. Windows"),
        ("t", 0, 3, "12"),
        ("t", 1, 0, "merited before the thresbold. Every window"),
        ("t", 2, 0, None),
        ("t", 2, 1, ""),
        ("t", 3, 0, "report written."),
        ("t", 3, 0, "report written."),
        ("t", 3, 1, "every planner"),
        (None, 1, 1, "12"),
        ("t", None, 1, "12"),
    ]
    out = {r for r in found(spark, rows) if r[0] == "t"}
    assert out == {
        ("t", 0, 0, 1, "furniture", ""), ("t", 0, 3, 1, "furniture", ""),
        ("t", 0, 1, 1, "misread", "authoritative"), ("t", 0, 1, 1, "misread", "2022"), ("t", 0, 1, 1, "broken_word", "deliberately"), ("t", 0, 1, 2, "broken_word", "multilingual"),
        ("t", 0, 1, 3, "broken_word", "documented"), ("t", 1, 0, 1, "misread", "documented"), ("t", 0, 1, 3, "continues", ""),
        ("t", 1, 0, 1, "misread", "threshold"), ("t", 1, 0, 1, "continues", ""),
    }


def test_furniture_is_what_repeats_at_the_edges(spark):
    rows = book()
    # a header without number or gap, in one scan; a stamp of one page in each of many scans; the same words within pages are body
    rows += [("h", i, j, text) for i in range(4) for j, text in enumerate(["Annals of the lower valley", *(f"every {WORDS[4 * i + j]} measures {WORDS[5 * j - i]}." for j in range(2)), "Annals of the lower valley", *(f"before {WORDS[4 * i + j]} measures {WORDS[4 * j - i]}." for j in range(3))])]
    rows += [(f"k{i}", 0, j, text) for i in range(8) for j, text in enumerate([f"every planner {WORDS[i]} measures.", f"Inv. {i}7 Mill Street 1ibrary" if i % 2 else f"Inv. {i}9 Mill Street Library"])]
    rows += [("o", 0, 0, "Annals of the upper valley"), ("o", 1, 0, "every planner measures.")]
    out = {r[:4] for r in found(spark, rows) if r[4] == "furniture" and r[0] not in {f"s{i}" for i in range(12)}}
    assert out == {("h", i, 0, 1) for i in range(4)} | {(f"k{i}", 0, 1, 1) for i in range(8)}


def test_compounds_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "PAGE_BUCKET", 2)
    rows = book() + [("u", i, 0, "A cross-encoder measures every window.") for i in range(9)]
    rows += [("v", i, 0, "every planner measures a cross-" if i % 2 == 0 else "encoder window.") for i in range(9)]
    out = {r for r in found(spark, rows) if r[0] == "v"}
    assert out == {("v", i, 0, 1, "continues", "") for i in (0, 2, 4, 6)}


def test_empty(spark):
    assert found(spark, book()[:1]) == {("s0", 0, 0, 1, "furniture", "")}
    df = spark.createDataFrame([], "scan_id string, page_index int, block_id int, block_content string")
    assert S.repairs_found(df).count() == 0


def test_paragraphs_are_put_together(spark):
    rows = book() + [
        ("t", 0, 0, "Bulletin    12"), ("t", 0, 1, "The Autboritative planner measures 2O22 windows delib-\nerately. The multi-\nlingual snapshot was docu\xad"), ("t", 0, 2, "Figure 3. Windows"),
        ("t", 1, 0, "merited before the thresbold. Every window"), ("t", 3, 0, "report written."), ("t", 3, 1, "令牌预算与\n快照。"), ("t", 3, 2, "4.1 Planner"),
    ]
    df = spark.createDataFrame(rows, "scan_id string, page_index int, block_id int, block_content string")
    got = {(r["page_index"], r["block_id"], r["kind"], r["text"]) for r in S.paragraphs(df).where("scan_id = 't'").collect()}
    assert got == {
        (0, 1, "para", "The Authoritative planner measures 2022 windows deliberately. The multilingual snapshot was documented before the threshold. Every window report written."),
        (0, 2, "caption", "Figure 3. Windows"), (3, 1, "para", "令牌预算与快照。"), (3, 2, "head", "4.1 Planner"),
    }

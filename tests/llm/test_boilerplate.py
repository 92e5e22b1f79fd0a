from cairn.llm import boilerplate as B
from cairn.llm.labelled_pages import BODY, labelled_pages

PAGE = """Home | Docs | Blog | Login
We and our 12 partners use cookies to keep this site running. Accept all | Settings
# How the planner measures windows
The planner measures every window before the report is written. It then waits for 12 seconds.

    window_size = 12
- dense windows
- sparse windows
## Login flow
Support · Skip to main content – If the limit is unset, the reader keeps every open window until the end of the run.
Related articles
- Why the planner rejects tables
Measuring dense windows in Alder Mesh
© 2024 Alder Mesh Project. All rights reserved.
Back to top"""


def test_body_of_a_page():
    assert B.outside_lines(B.trained(), PAGE, "How the planner measures windows") == [1, 2, 11, 12, 13, 14, 15]


def test_accuracy_on_held_out_pages():
    wrong = total = 0
    for lines, title in labelled_pages(150, seed=77):
        text = "\n".join(line for line, _ in lines)
        out = set(B.outside_lines(B.trained(), text, title))
        for n, (line, label) in enumerate(lines, 1):
            if line.strip():
                total += 1
                wrong += (n in out) != (label != BODY)
    assert total > 2000 and wrong / total < 0.01


def test_rows(spark):
    rows = [(1, None, PAGE, None), (2, "t", "", "  \n "), (3, None, "Back to top\r\nSome text of the body stands here, and it goes on.\r", None), (1, None, PAGE, None), (None, None, PAGE, None)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "item_id bigint, title string, page string, source string, line_no int")
    found = B.find_boilerplate(df, "item_id", "title", ["page", "source"])
    lines = B.boilerplate_lines(found, "item_id").collect()
    assert len(lines) == len(set(lines)) and all(r["item_id"] is not None for r in lines)
    assert {(r["item_id"], r["line_no"]) for r in lines if r["item_id"] == 3} == {(3, 1)}
    assert {r["item_id"] for r in lines} == {1, 3}
    bodies = {(r["item_id"], r["field"]): r["body"] for r in found.collect()}
    assert bodies[(2, "page")] == "" and "Login flow" in bodies[(1, "page")] and "cookies" not in bodies[(1, "page")]
    assert B.boilerplate_lines(B.find_boilerplate(df.where("false"), "item_id", "title", ["page"]), "item_id").count() == 0


def test_very_long_page():
    text = "\n".join(["The reader keeps every open window until the end of the run, as it should."] * 20_000 + ["Back to top"])
    assert B.outside_lines(B.trained(), text)[-1] == 20_001


def test_pages_of_other_sites():
    from hand_pages import labelled

    right = total = 0
    for title, text, outside in labelled():
        found = set(B.outside_lines(B.trained(), text, title))
        n = len(text.split("\n"))
        total += n
        right += n - len(found ^ outside)
    assert total > 100 and right / total > 0.9, right / total

"""Quotes in Markdown, and the whole snippet in quote_grounding."""

import __spark_entry__ as entry
from cairn.functions import passages


def test_markdown_view_keeps_raw_places():
    source = "### Release notes\nUse [the official guide](https://example.test/a_(b)) for **CVE-2026-1234**.\n\\*Run `cargo --version` with `foo_bar`, <b>not</b> ![alt](x.png) <https://e.test/x>."
    seen, places = passages.markdown_view(source)
    assert seen == "Release notes\nUse the official guide for CVE-2026-1234.\n*Run cargo --version with foo_bar, not alt https://e.test/x."
    assert len(places) == len(seen) and all(source[p] == c for p, c in zip(places, seen, strict=True))
    assert places == sorted(set(places))


def test_quote_of_visible_markdown():
    source = "OpenSSL released [patches](https://example.test) for **CVE-2026-1234**."
    assert passages.locate_quote(source, "OpenSSL released patches for CVE-2026-1234.") == (0, len(source), "markdown_visible_exact")
    assert passages.locate_quote("Visit <https://example.test/guide> for it.", "visit https://example.test/guide for it.") == (0, 42, "markdown_visible_exact")
    source = "x😀 Straße [and  on](u) went"
    assert passages.locate_quote(source, "strasse and on went") == (3, len(source), "markdown_visible_exact")
    assert passages.locate_quote("Affected areas include Hubei north and west.", "Affected areas include Hubei northwest.") is None


def test_the_whole_snippet_is_searched(spark, tmp_path):
    head = "The relay keeps the ledger of every snapshot that the planner took since the last release of this harbor, "
    excerpt = "Intro. " + head + "and drops it after a week. More."
    items = [("whole", head + "and drops it after a week.", excerpt), ("differs", head + "and keeps it for a year.", excerpt), ("linked", head + "and drops it after a week.", excerpt.replace("a week", "[a week](https://e.test)")), ("null", None, excerpt)]
    spark.createDataFrame(items, "item_id string, snippet string, page_excerpt string").write.parquet(f"{tmp_path}/evidence_items.parquet")
    got = {r["item_id"]: (r["start_char"], r["end_char"], r["basis"]) for r in entry.queries()["quote_grounding"](spark, str(tmp_path)).collect()}
    end = 7 + len(items[0][1])
    assert got == {"whole": (7, end, "exact"), "differs": (None, None, None), "linked": (7, end + 18, "markdown_visible_exact"), "null": (None, None, None)}

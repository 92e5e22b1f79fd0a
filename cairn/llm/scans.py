"""Text of scanned pages repaired: furniture removed, divided words joined, misread characters corrected.

1. Furniture is what repeats: a line at the edge of a page whose words, numbers and look-alikes aside, stand at
   the edge of another page of the scan, or of many scans. Page numbers, alone or beside a wide gap, are known by form.
   Pages are read one by one (a page is the largest unit any task holds): their lines are told apart as
   furniture, headings, captions, tables and paragraphs, and split into tokens; words divided at a line end
   are set aside with what follows them. Only the last paragraph line of each page looks at a later page.
2. The corpus lexicon counts the undivided words, map-side first. Its frequent words form a symmetric-delete
   index: each word under all forms with up to two neighbouring characters deleted, and under a form with
   look-alike glyphs folded. A suspect word meets its candidates where their forms agree.
3. Candidates are weighed by an edit distance in which look-alikes are cheap and anything else is dear, and
   must be far more frequent than the suspect. Where several are left, the words before and after decide.
4. A divided word is joined if the lexicon has it joined, and kept as a compound if it has it with a hyphen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import ordered, skew
from cairn.session import checkpointed

#: Glyphs as read, and what they may stand for.
LOOKALIKES = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("9", "g"), ("8", "b"), ("6", "b"), ("2", "z"), ("@", "a"), ("|", "l"), ("|", "i"), ("$", "s"), ("!", "l"), ("!", "i"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("l", "i"), ("i", "l"), ("u", "v"), ("v", "u"), ("n", "u"), ("u", "n"), ("o", "c"), ("c", "o"), ("q", "g"), ("g", "q"),
    ("ri", "n"), ("n", "ri"), ("rn", "m"), ("m", "rn"), ("m", "in"), ("in", "m"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("h", "li"), ("ni", "m"), ("m", "ni"),
    ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
)
#: Glyphs read in place of digits.
DIGITS = str.maketrans("OoIl|isSBbZzgq", "00111155862299")
#: Marks that divide a word at the end of a line.
MARKS = "-­‐‑¬"
#: A candidate must be so many times as frequent as a suspect of letters only.
RATIO = 8
#: Suspects, and pairs of words, that may be broadcast (some 60 bytes each); beyond it they are joined by shuffle.
BROADCAST_WORDS = 200_000
#: Cost of a look-alike, of any other edit, and the most that a repair may cost.
NEAR, FAR, MOST = 1.0, 3.0, 2.0
#: Blocks at the top and at the bottom of a page among which its furniture is looked for.
TOP, BOTTOM = 2, 3
#: A line is a stamp if it stands in so many scans, of a thousand and at least, and so often at the edge of a page.
STAMP_SHARE, STAMP_SCANS, STAMP_EDGE = 0.001, 5, 0.8
#: Pages of one scan that are linked in one window; scans of more pages are linked bucket by bucket.
PAGE_BUCKET = 256

_number = r"[\[\-–— (]*(?:(?=[0-9OolISBZ|]*[0-9OlSB])[0-9OolISBZ|]{1,5}|[ivxlc1]{1,6}|[Pp]age [0-9OolISB|]{1,5}(?: of [0-9OolISB|]{1,5})?|第 ?[0-9OolISB|]{1,5} ?页)[\]\-–— )]*"
_page_number = re.compile(_number)
_running = re.compile(rf"(?:{_number}\s{{3,}}\S.*|\S.*\s{{3,}}{_number})")
_wide = re.compile(r"\s{3}")
_heading = re.compile(r"(?:[0-9OlISB]{1,3}(?:\.[0-9OlISB]{1,3})+\.? \S.{0,80}|第 ?[0-9OlISB一二三四五六七八九十]{1,4} ?[节章] .{0,40})")
_caption = re.compile(r"(?:Figure|Fig\.|Table|Abbildung|Tabelle|图|表) ?[0-9OlISB]{1,4}\b.{0,90}")
_tag = re.compile(r"<[^<>]*>")
_token = re.compile(r"(?:[^\W㐀-鿿]+|[@|$]+)+(?:[-'’.,:/](?:[^\W㐀-鿿]+|[@|$]+)+)*")
_numeric = re.compile(r"[0-9OoIl|isSBbZzgq]+(?:[.,:/-][0-9OoIl|isSBbZzgq]+)*")
_ended = re.compile(r"[.!?。！？][\"'”’)\]」』]*\s*$")
_divided = re.compile(rf"((?:(?![㐀-鿿])[^\W_]|[@|$ﬁ'’-])*(?:(?![㐀-鿿])[^\W\d_]|[@|$ﬁ]))([{MARKS}])\s*$")

LINE = "block_id int, line_no int, kind string, words array<string>, numbers array<string>, lead string, left string, mark string, right string, right_block int, right_line int, first boolean, last boolean, closes boolean, text string"


def number_repair(token: str) -> str | None:
    """The number that a token of digits and digit look-alikes stands for; None if it is no such token."""
    if token.isalpha() or not _numeric.fullmatch(token):
        return None
    digits, letters = sum(c.isdigit() for c in token), sum(c.isalpha() or c == "|" for c in token)
    if not letters or digits < letters or (digits == 1 and letters == 1 and len(token) < 2):
        return None
    return token.translate(DIGITS)


def is_furniture(line: str, alone: bool, edge: bool) -> bool:
    """Whether a line is a page number, or one beside a wide gap, by its form alone.

    ``alone``: it is all of its block; ``edge``: it is the first or last line of its page.
    """
    text = line.strip()
    if _wide.search(text) and _running.fullmatch(text):
        return True
    return (alone or edge) and bool(_page_number.fullmatch(text))


def repeated_lines(pages: DataFrame) -> DataFrame:
    """(scan_id, page_index, furniture): places (block_id, line_no) of the blocks of one line of ``pages`` that repeat at the edges of pages."""
    # a line within a block of several is told by its form alone, as ends of paragraphs repeat too
    whole = F.filter("blocks", lambda b: F.trim(F.coalesce(b["block_content"], F.lit(""))) != "")
    placed = pages.select("scan_id", "page_index", whole.alias("blocks")).select("scan_id", "page_index", F.size("blocks").alias("n"), F.posexplode("blocks").alias("at", "block"))
    placed = placed.where(~F.contains("block.block_content", F.lit("\n")))
    edge = (F.col("at") < TOP) | (F.col("at") >= F.col("n") - BOTTOM)
    # numbers, and whatever may be misread for one another, are made one
    words = F.regexp_replace(F.translate(F.lower(F.trim("block.block_content")), "0123456789oil|sbzgq\tecftuvnhm", "0000000000000000000 cctfuuuuu"), "0+", "0")
    mask = F.when(words.rlike(r"\p{L}\P{L}*\p{L}\P{L}*\p{L}") & ~words.startswith("<"), F.xxhash64(F.regexp_replace(words, " +", " ")))
    masked = placed.select("scan_id", "page_index", F.col("block.block_id").alias("block_id"), F.lit(1).alias("line_no"), edge.alias("edge"), mask.alias("mask")).where("mask IS NOT NULL")
    by_page = masked.groupBy("scan_id", "mask", "page_index").agg(F.count("*").alias("n"), F.count_if("edge").alias("n_edge"))
    by_scan = by_page.groupBy("scan_id", "mask").agg(F.sum("n").alias("n_all"), F.sum("n_edge").alias("n_edge"), F.count_if(F.col("n_edge") > 0).alias("n_pages"))
    by_scan = checkpointed(by_scan.where("n_edge > 0"))
    scans = pages.agg(F.approx_count_distinct("scan_id")).first()[0] or 0
    often = by_scan.groupBy("mask").agg(F.count("*").alias("n_scans"), F.sum("n_all").alias("n_all"), F.sum("n_edge").alias("n_edge"))
    # as every page has few edge lines, so large a share of all scans leaves room for a bounded number of stamps
    stamps = often.where((F.col("n_scans") >= max(STAMP_SCANS, STAMP_SHARE * scans)) & (F.col("n_edge") >= STAMP_EDGE * F.col("n_all"))).select("mask", F.lit(True).alias("stamp"))
    known = by_scan.join(F.broadcast(stamps), "mask", "left").where("n_pages > 1 OR stamp").select("scan_id", "mask", F.col("n_edge").alias("n"))
    found = skew.join_counted(masked.where("edge").drop("edge"), known, ["scan_id", "mask"])
    return found.groupBy("scan_id", "page_index").agg(F.collect_set(F.struct("block_id", "line_no")).alias("furniture"))


def page_lines(blocks: list[dict], furniture: set[tuple[int, int]] = frozenset()) -> list[dict]:
    """Rows of LINE for the lines of one page, whose blocks are in reading order; ``furniture``: places known to be that."""
    split = [(b["block_content"] or "").split("\n") for b in blocks]
    rows, flow = [], []
    places = [(i, j) for i, lines in enumerate(split) for j in range(len(lines)) if lines[j].strip()]
    if all((blocks[i]["block_id"], j + 1) in furniture for i, j in places):
        furniture = frozenset()  # a page that repeats as a whole is no furniture
    for i, j in places:
        line, lines = split[i][j], split[i]
        edge = (i, j) in (places[0], places[-1])
        rest = [x for x in lines if x.strip()]
        kind = "furniture" if (blocks[i]["block_id"], j + 1) in furniture or is_furniture(line, len(rest) == 1, edge) else "body"
        rows.append({"block_id": blocks[i]["block_id"], "line_no": j + 1, "kind": kind, "text": line, "at": i})
    for i in range(len(split)):
        body = [r for r in rows if r["at"] == i and r["kind"] == "body"]
        if not body:
            continue
        whole = "\n".join(r["text"] for r in body)
        if whole.lstrip().startswith("<table"):
            kind = "table"
        elif len(body) <= 2 and _caption.match(body[0]["text"].strip()) and not _ended.search(whole):
            kind = "caption"
        else:
            kind = "para"
        for n, r in enumerate(body):
            r["kind"] = kind
            if kind == "para" and len(body) - n == 1 and n == 0 and _heading.fullmatch(r["text"].strip()) and not _ended.search(r["text"]):
                r["kind"] = "head"
        paras = [r for r in body if r["kind"] == "para"]
        if paras:
            paras[-1]["closes"] = not _ended.search(paras[-1]["text"])
        flow += paras
    for n, r in enumerate(flow):
        found = _divided.search(r["text"]) if r["text"].rstrip()[-1:] in MARKS else None
        r["left"], r["mark"] = (found.group(1), found.group(2)) if found else (None, None)
        r["first"], r["last"] = n == 0, n == len(flow) - 1
    taken = {id(b) for a, b in zip(flow, flow[1:], strict=False) if a["left"]}
    for a, b in zip(flow, flow[1:], strict=False):
        if a["left"]:
            begin = _token.match(b["text"].lstrip())
            a["right"], a["right_block"], a["right_line"] = (begin.group() if begin else ""), b["block_id"], b["line_no"]
    for r in rows:
        text = _tag.sub(" ", r["text"])
        if r.get("left"):
            text = _divided.sub("", text)
        spans = [m.group() for m in _token.finditer(text)] if r["kind"] != "furniture" else []
        starts = bool(_token.match(text.lstrip()))
        if spans and starts and id(r) in taken:
            spans = spans[1:]
        elif spans and starts and r.get("first"):
            r["lead"], spans = spans[0], spans[1:]
        words, numbers = [], []
        for token in spans:
            fixed = number_repair(token)
            if fixed:
                numbers.append(fixed.lower())
            words.append("" if fixed else token.lower().strip("-'’.,:/"))
        r["words"], r["numbers"] = words, numbers
    return rows


def _pages(blocks: DataFrame) -> DataFrame:
    """Lines of all pages, with scan_id and page_index."""
    once = blocks.where("scan_id IS NOT NULL AND page_index IS NOT NULL AND block_id IS NOT NULL").select("scan_id", "page_index", F.struct("block_id", "block_content").alias("block"))
    pages = checkpointed(once.groupBy("scan_id", "page_index").agg(F.array_sort(F.collect_set("block")).alias("blocks")))
    pages = pages.join(repeated_lines(pages), ["scan_id", "page_index"], "left").select("scan_id", "page_index", "blocks", "furniture")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in LINE.split(", ")]
        strings, ints, flags = pa.string(), pa.int32(), pa.bool_()
        kinds = {"block_id": ints, "line_no": ints, "words": pa.list_(strings), "numbers": pa.list_(strings), "right_block": ints, "right_line": ints, "first": flags, "last": flags, "closes": flags}
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                which, rows = [], []
                for i, (found, known) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    seen: dict[int, dict] = {}
                    for b in found:  # repeated identical rows are gone; of others with one key the first counts
                        seen.setdefault(b["block_id"], b)
                    for r in page_lines(list(seen.values()), {(k["block_id"], k["line_no"]) for k in known or ()}):
                        which.append(i)
                        rows.append(r)
                at = pa.array(which, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at)] + [pa.array([r.get(n) for r in rows], kinds.get(n, strings)) for n in names], ["scan_id", "page_index", *names])

    return pages.mapInArrow(run, "scan_id string, page_index int, " + LINE)


def _next_pages(lines: DataFrame) -> DataFrame:
    """(scan_id, page_index, next_page, next_lead, next_block, next_line): the next page with a paragraph line."""
    first = lines.where("first").select("scan_id", "page_index", F.struct("page_index", "lead", "block_id", "line_no").alias("here"), F.floor(F.col("page_index") / PAGE_BUCKET).alias("bucket"))
    inside = first.withColumn("after", F.lead("here").over(Window.partitionBy("scan_id", "bucket").orderBy("page_index")))
    heads = first.groupBy("scan_id", "bucket").agg(F.min("here").alias("head"))
    later = heads.withColumn("beyond", F.lead("head").over(Window.partitionBy("scan_id").orderBy("bucket"))).select("scan_id", "bucket", "beyond").where("beyond IS NOT NULL")
    linked = inside.join(later, ["scan_id", "bucket"], "left").withColumn("to", F.coalesce("after", "beyond"))
    return linked.where("to IS NOT NULL").select("scan_id", "page_index", F.col("to.page_index").alias("next_page"), F.col("to.lead").alias("next_lead"), F.col("to.block_id").alias("next_block"), F.col("to.line_no").alias("next_line"))


# ---- the index and the distance


def fold(word: Column) -> Column:
    """Word with look-alike glyphs made one."""
    for run, single in (("ri", "n"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("in", "m"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        word = F.regexp_replace(word, run, single)
    return F.concat(F.lit("="), F.translate(word, "015982@|$icfbq", "olsgbzalsletHg".lower()))


def delete_keys(word: Column) -> Column:
    """All forms of a word under which the index holds it."""
    size = F.length(word)

    def without(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + n, size)))

    return F.array_distinct(F.concat(F.array(word, fold(word)), F.when(size >= 3, without(1)).otherwise(F.array().cast("array<string>")), F.when(size >= 4, without(2)).otherwise(F.array().cast("array<string>"))))


@lru_cache(maxsize=1)
def _costs() -> dict[tuple[str, str], float]:
    return {(a, b): NEAR for a, b in LOOKALIKES}


def distance(read: str, true: str) -> float:
    """Least cost of turning ``read`` into ``true`` by look-alikes and single edits."""
    a = 0
    while a < min(len(read), len(true)) and read[a] == true[a]:
        a += 1
    z = 0
    while z < min(len(read), len(true)) - a and read[-1 - z] == true[-1 - z]:
        z += 1
    # one glyph of margin, since a look-alike of two glyphs may share one with its neighbours
    a, z = max(0, a - 1), max(0, z - 1)
    read, true, costs = read[a : len(read) - z], true[a : len(true) - z], _costs()
    if abs(len(read) - len(true)) > 4:
        return FAR * abs(len(read) - len(true))
    best = [[FAR * (i + j) for j in range(len(true) + 1)] for i in range(len(read) + 1)]
    for i in range(len(read) + 1):
        for j in range(len(true) + 1):
            here = best[i][j]
            if i and j:
                here = min(here, best[i - 1][j - 1] + (0.0 if read[i - 1] == true[j - 1] else FAR))
            if i:
                here = min(here, best[i - 1][j] + FAR)
            if j:
                here = min(here, best[i][j - 1] + FAR)
            for x in (1, 2):
                for y in (1, 2, 3):
                    if x <= i and y <= j:
                        c = costs.get((read[i - x : i], true[j - y : j]))
                        if c is not None:
                            here = min(here, best[i - x][j - y] + c)
            best[i][j] = here
    return best[-1][-1]


def _distances(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for read, true in pairs:
        yield pd.Series([distance(a, b) for a, b in zip(read, true, strict=True)], dtype=float)


def candidates(suspects: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, fixed, cost, n_fixed): what each of ``suspects`` (word, n) may stand for, of the words of ``lexicon`` (word, n).

    Words of under 3 letters have no candidates. The index is joined on its forms; a form of two letters
    or less is not used, so no form is common to more than a few words of like spelling.
    """
    def index(df: DataFrame) -> DataFrame:
        return df.withColumn("key", F.explode(delete_keys(F.col("word")))).where(F.length("key") >= 3)

    true = lexicon.where(r"n >= 2 AND length(word) >= 3 AND word RLIKE '^\\p{L}[\\p{L}_\'’-]*\\p{L}$'").select("word", "n")
    left = index(suspects.where(r"length(word) >= 3 AND word RLIKE '[\\p{L}@|$]'").select("word", "n"))
    right = index(true).select("key", F.col("word").alias("fixed"), F.col("n").alias("n_fixed"))
    odd = F.col("word").rlike(r"[0-9@|$ﬁﬂ]")
    frequent = F.when(odd, (F.col("n_fixed") >= 2) & (F.col("n_fixed") > F.col("n"))).otherwise((F.col("n_fixed") >= 5) & (F.col("n_fixed") >= RATIO * F.col("n")))
    pairs = left.join(right, "key").where((F.col("word") != F.col("fixed")) & frequent).select("word", "n", "fixed", "n_fixed").distinct()
    cost = F.pandas_udf(_distances, "double")
    return pairs.withColumn("cost", cost("word", "fixed")).where(F.col("cost") <= MOST).select("word", "fixed", "cost", "n_fixed")


def _best(found: DataFrame, *by: str) -> DataFrame:
    """The cheapest, then the most frequent candidate of each word."""
    return found.groupBy(*by).agg(F.min(F.struct(F.col("cost"), (-F.col("n_fixed")).alias("less"), F.col("fixed"))).alias("b")).select(*by, F.col("b.fixed").alias("fixed"), (-F.col("b.less")).alias("n_fixed"))


def analyse(blocks: DataFrame) -> dict[str, DataFrame]:
    """Lines, links between pages, divided words and misread words of ``blocks``; see :func:`repairs_found`."""
    lines = checkpointed(_pages(blocks))
    links = _next_pages(lines)
    key = ["scan_id", "page_index", "block_id", "line_no"]
    across = lines.where("last AND left IS NOT NULL").join(links, ["scan_id", "page_index"]).select(*key, "left", "mark", F.coalesce("next_lead", F.lit("")).alias("right"), F.col("next_page").alias("right_page"), F.col("next_block").alias("right_block"), F.col("next_line").alias("right_line"))
    within = lines.where("left IS NOT NULL AND NOT last").select(*key, "left", "mark", "right", F.col("page_index").alias("right_page"), "right_block", "right_line")
    strip = lambda c: F.lower(F.regexp_replace(c, r"^[-'’.,:/]+|[-'’.,:/]+$", ""))
    divided = within.unionByName(across).withColumn("left", strip(F.col("left"))).withColumn("right", strip(F.col("right"))).where("left <> '' AND right <> ''")
    divided = checkpointed(divided.withColumn("joined", F.concat("left", "right")).withColumn("hyphened", F.concat("left", F.lit("-"), "right")))
    # first words of pages that are no rest of a divided word are words of their lines after all
    used = across.select("scan_id", F.col("right_page").alias("page_index")).withColumn("used", F.lit(True))
    leads = lines.where("lead IS NOT NULL").select(*key, "lead").join(used, ["scan_id", "page_index"], "left").where("used IS NULL").select(*key, strip(F.col("lead")).alias("word"), F.lit("").alias("before"), F.lit("").alias("after"))
    placed = lines.select(*key, F.posexplode("words").alias("at", "word"), "words").where("word <> ''")
    occurrences = placed.select(*key, "word", F.coalesce(F.when(F.col("at") > 0, F.element_at("words", F.greatest(F.col("at"), F.lit(1)))), F.lit("")).alias("before"), F.coalesce(F.try_element_at("words", F.col("at") + 2), F.lit("")).alias("after"))
    occurrences = occurrences.unionByName(leads)
    lexicon = checkpointed(occurrences.groupBy("word").agg(F.count("*").alias("n")))
    forms = divided.select(F.explode(F.array("joined", "hyphened")).alias("word")).distinct().join(lexicon, "word", "left_anti").select("word", F.lit(0).cast("bigint").alias("n"))
    found = checkpointed(candidates(lexicon.unionByName(forms), lexicon))
    return {"lines": lines, "links": links, "divided": divided, "occurrences": occurrences, "lexicon": lexicon, "candidates": found}


def _rare(occurrences: DataFrame, lexicon: DataFrame, ways: DataFrame) -> DataFrame:
    """``occurrences`` without those of the most frequent words that nothing may correct: they are most of a text, and would make a join on words uneven."""
    hot = skew.hot_keys(lexicon, ["word"], "n", lexicon.agg(F.sum("n")).first()[0] or 0)
    return occurrences if hot is None else occurrences.join(F.broadcast(hot.select("word").join(ways, "word", "left_anti")), "word", "left_anti")


def misread_words(parts: dict[str, DataFrame]) -> DataFrame:
    """(key, word, fixed) of each occurrence of a misread word, its neighbours deciding between equal candidates."""
    found, occurrences = parts["candidates"], parts["occurrences"]
    key = ["scan_id", "page_index", "block_id", "line_no"]
    least = found.groupBy("word").agg(F.min("cost").alias("least"))
    tied = found.join(least, "word").where("cost = least")
    several = tied.groupBy("word").agg(F.count("*").alias("n_ways"))
    ways = checkpointed(tied.join(several, "word").select("word", "fixed", "cost", "n_fixed", "n_ways"))
    occurrences = _rare(occurrences, parts["lexicon"], ways)
    small = ways.count() <= BROADCAST_WORDS
    sent = F.broadcast(ways) if small else ways
    sure = occurrences.join(sent.where("n_ways = 1").select("word", "fixed"), "word").select(*key, "word", "fixed")
    open_ = checkpointed(occurrences.join(sent.where("n_ways > 1").drop("n_ways"), "word"))
    wanted = open_.select(F.explode(F.array(F.struct(F.col("before").alias("a"), F.col("fixed").alias("b")), F.struct(F.col("fixed").alias("a"), F.col("after").alias("b")))).alias("p")).select("p.*").where("a <> '' AND b <> ''").distinct()
    wanted = checkpointed(wanted)
    every = parts["occurrences"].where("before <> ''").select(F.col("before").alias("a"), F.col("word").alias("b"))
    pairs = every.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_WORDS else wanted, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("n"))
    context = open_.join(pairs.select(F.col("a").alias("before"), F.col("b").alias("fixed"), F.col("n").alias("n_before")), ["before", "fixed"], "left")
    context = context.join(pairs.select(F.col("a").alias("fixed"), F.col("b").alias("after"), F.col("n").alias("n_after")), ["fixed", "after"], "left")
    score = F.log1p(F.coalesce("n_before", F.lit(0))) + F.log1p(F.coalesce("n_after", F.lit(0))) + F.log1p("n_fixed") / 10
    chosen = context.groupBy(*key, "word", "before", "after").agg(F.max(F.struct(score.alias("score"), "fixed")).alias("b")).select(*key, "word", F.col("b.fixed").alias("fixed"))
    return sure.unionByName(chosen)


def divided_words(parts: dict[str, DataFrame]) -> DataFrame:
    """The divided words with ``word``, the whole correct word, and ``broken``: false for a compound's own hyphen."""
    best = _best(parts["candidates"], "word")
    known = parts["lexicon"].select("word", "n").join(best, "word", "full").select("word", F.coalesce("fixed", "word").alias("fixed"), F.coalesce("n_fixed", "n").alias("weight"), F.coalesce("n", F.lit(0)).alias("n"))
    out = parts["divided"]
    for form in ("joined", "hyphened"):
        out = out.join(known.select(F.col("word").alias(form), F.col("fixed").alias(f"{form}_fixed"), F.col("weight").alias(f"{form}_weight")), form, "left")
    for side in ("left", "right"):
        out = out.join(known.where("n >= 3").select(F.col("word").alias(side), F.lit(True).alias(f"{side}_known")), side, "left")
    joined, hyphened = F.coalesce("joined_weight", F.lit(0)), F.coalesce("hyphened_weight", F.lit(0))
    unknown = (F.col("mark") != "-") | F.col("left_known").isNull() | F.col("right_known").isNull()
    broken = F.when((joined > 0) | (hyphened > 0), joined >= hyphened).otherwise(unknown)
    word = F.when(broken, F.coalesce("joined_fixed", "joined")).otherwise(F.coalesce("hyphened_fixed", "hyphened"))
    return out.withColumn("broken", broken).withColumn("word", word)


def repairs_found(blocks: DataFrame) -> DataFrame:
    """(scan_id, page_index, block_id, line_no, kind, word): furniture, broken_word, misread and continues.

    ``blocks`` has scan_id, page_index, block_id and block_content; labels are not trusted. Repeated
    rows count once, rows with a null in the key are left out, null and empty contents have no lines.
    """
    parts = analyse(blocks)
    key = ["scan_id", "page_index", "block_id", "line_no"]
    lines = parts["lines"]
    empty = F.lit("").alias("word")
    furniture = lines.where("kind = 'furniture'").select(*key, F.lit("furniture").alias("kind"), empty)
    divided = checkpointed(divided_words(parts))
    broken = divided.where("broken").select(*key, F.lit("broken_word").alias("kind"), "word")
    whole = F.when(F.col("broken"), F.col("joined")).otherwise(F.col("hyphened"))
    wrong = divided.withColumn("read", whole).where("read <> word")
    on_left = ~F.col("word").startswith(F.col("left"))
    on_right = ~F.col("word").endswith(F.col("right"))
    left = wrong.where(on_left).select(*key, F.lit("misread").alias("kind"), "word")
    right = wrong.where(on_right).select("scan_id", F.col("right_page").alias("page_index"), F.col("right_block").alias("block_id"), F.col("right_line").alias("line_no"), F.lit("misread").alias("kind"), "word")
    misread = misread_words(parts).select(*key, F.lit("misread").alias("kind"), F.col("fixed").alias("word"))
    numbers = lines.select(*key, F.lit("misread").alias("kind"), F.explode("numbers").alias("word"))
    last = lines.where("closes")
    here = last.where("NOT last").select(*key)
    there = last.where("last").join(parts["links"].select("scan_id", "page_index"), ["scan_id", "page_index"], "left_semi").select(*key)
    goes_on = here.unionByName(there).select(*key, F.lit("continues").alias("kind"), empty)
    out = furniture
    for other in (broken, left, right, misread, numbers, goes_on):
        out = out.unionByName(other)
    return out.distinct()


def _repaired_pages(parts: dict[str, DataFrame]) -> DataFrame:
    """(scan_id, page_index, pieces): the body of each page as pieces of text, repaired, with an open end where a paragraph goes on."""
    key = ["scan_id", "page_index", "block_id", "line_no"]
    words = misread_words(parts).select(*key, F.struct(F.lit("word").alias("kind"), F.col("word").alias("a"), F.col("fixed").alias("b")).alias("fix"))
    divided = checkpointed(divided_words(parts))
    whole = F.when(F.col("broken"), F.col("joined")).otherwise(F.col("hyphened"))
    ends = divided.select(*key, F.struct(F.when(F.col("broken"), "joined").otherwise("kept").alias("kind"), whole.alias("a"), F.col("word").alias("b")).alias("fix"))
    rests = divided.select("scan_id", F.col("right_page").alias("page_index"), F.col("right_block").alias("block_id"), F.col("right_line").alias("line_no"), F.struct(F.lit("rest").alias("kind"), F.col("right").alias("a"), F.lit("").alias("b")).alias("fix"))
    fixes = words.unionByName(ends).unionByName(rests).groupBy("scan_id", "page_index").agg(F.collect_set(F.struct("block_id", "line_no", "fix")).alias("fixes"))
    body = parts["lines"].where("kind <> 'furniture'")
    pages = body.groupBy("scan_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("block_id", "line_no", "kind", "closes", "text"))).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pa.struct([("block_id", pa.int32()), ("kind", pa.string()), ("open_end", pa.bool_()), ("text", pa.string())])
        for batch in batches:
            out = [page_pieces(lines, fixes or []) for lines, fixes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(piece))], ["scan_id", "page_index", "pieces"])

    joined = pages.join(fixes, ["scan_id", "page_index"], "left")
    return joined.mapInArrow(run, "scan_id string, page_index int, pieces array<struct<block_id: int, kind: string, open_end: boolean, text: string>>")


def _cased(read: str, fixed: str) -> str:
    return fixed.upper() if read.isupper() and len(read) > 1 else fixed[:1].upper() + fixed[1:] if read[:1].isupper() else fixed


def page_pieces(lines: list[dict], fixes: list[dict]) -> list[dict]:
    """The blocks of a page as running text: words corrected, divided ones joined, lines put together."""
    by_line: dict[tuple[int, int], list[dict]] = {}
    for f in fixes:
        by_line.setdefault((f["block_id"], f["line_no"]), []).append(f["fix"])
    pieces: list[dict] = []
    for row in lines:
        text, end = row["text"].strip(), None
        todo = by_line.get((row["block_id"], row["line_no"]), [])
        for f in todo:
            if f["kind"] == "rest" and text.lower().startswith(f["a"]):
                text = text[len(f["a"]) :].lstrip(" ")
            elif f["kind"] in ("joined", "kept"):
                end = f
        if end:
            stem = _divided.search(text)
            head = text[: stem.start()] if stem else text
            read = stem.group(1) if stem else ""
            text = head + "\0"
        known = {f["a"]: f["b"] for f in todo if f["kind"] == "word"}

        def repaired(m: re.Match[str], known: dict[str, str] = known) -> str:
            token = m.group()
            number = number_repair(token)
            core = token.strip("-'’.,:/")
            fixed = known.get(core.lower())
            return number if number else token.replace(core, _cased(core, fixed)) if fixed and core else token

        if row["kind"] != "table":
            text = _token.sub(repaired, text)
        if end:
            text = text.replace("\0", _cased(read, end["b"]))
        last = pieces[-1] if pieces and pieces[-1]["block_id"] == row["block_id"] and pieces[-1]["kind"] == row["kind"] else None
        if last is None:
            pieces.append({"block_id": row["block_id"], "kind": row["kind"], "open_end": False, "text": text})
            last = pieces[-1]
        elif text:
            last["text"] += _gap(last["text"], text) + text
        last["open_end"] = bool(row["closes"])
    return pieces


def _gap(a: str, b: str) -> str:
    """What goes between two lines: nothing before a stop or between ideographs, else a space."""
    wide = "㐀" <= a[-1:] <= "鿿" or a[-1:] in "，。；：、"
    return "" if not a or b[:1] in ".,;:!?。，；：" or wide and ("㐀" <= b[:1] <= "鿿" or b[:1] in "（《“") else " "


def paragraphs(blocks: DataFrame) -> DataFrame:
    """(scan_id, page_index, block_id, kind, text): the repaired text of each scan, a row for each paragraph, heading, caption and table.

    page_index and block_id tell where it begins. A paragraph that goes on in a later block takes in what
    follows there, over headings of pages, figures and page breaks. Furniture is left out. The pieces of a
    paragraph are numbered by a running count over the scan's pages, bucket by bucket.
    """
    parts = analyse(blocks)
    pieces = checkpointed(_repaired_pages(parts).select("scan_id", "page_index", F.posexplode("pieces").alias("at", "p")).select("scan_id", "page_index", "at", "p.*"))
    # a piece begins a paragraph unless the piece before it in the scan has an open end; numbers are found without the texts
    place = ["scan_id", "page_index", "at"]
    before = ordered.previous(pieces.where("kind = 'para'").select(*place, "open_end"), ["scan_id"], ["page_index", "at"], "open_end", "held")
    begun = before.select(*place, (~F.coalesce("held", F.lit(False))).cast("int").alias("begins"))
    numbered = ordered.running(begun, ["scan_id"], ["page_index", "at"], {"paragraph": ("sum", "begins")}).select(*place, "paragraph")
    texts = pieces.where("kind = 'para'").join(numbered, place).groupBy("scan_id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("page_index", "at", "block_id", "text"))).alias("l"))
    glued = F.aggregate(F.transform("l", lambda x: x["text"]), F.lit(""), lambda a, b: F.when((a == "") | (b == ""), F.concat(a, b)).when(a.rlike("[㐀-鿿，。；：、]$") & b.rlike("^[㐀-鿿]"), F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b)))
    whole = texts.select("scan_id", F.col("l")[0]["page_index"].alias("page_index"), F.col("l")[0]["block_id"].alias("block_id"), F.lit("para").alias("kind"), glued.alias("text"))
    return whole.unionByName(pieces.where("kind <> 'para'").select("scan_id", "page_index", "block_id", "kind", "text"))

"""Main body of pages: a linear-chain conditional random field over line blocks, decoded by Viterbi.

The excerpts hold the leaf blocks of pages as lines, with their tags as line marks: headings, list items,
table rows, code, links. A block's features are its mark, its text (words, shape, length, punctuation), the
marks of its neighbours, its place, and on how many of all pages the same line stands. The field has one state for the main body and three for what
surrounds it: menus, teasers for other pages, and notices and footers. It is trained on a bounded sample of
labelled pages on the driver and shipped with the tasks as one small array; each page is decoded on its own
in a narrow stage.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.labelled_pages import BODY, labelled_pages
from cairn.operators import skew

STATES = 4
#: Labelled pages of the training sample.
TRAINING_PAGES = 1200
EPOCHS = 14
#: Lines of up to a thousand characters, and contexts, whose weights a worker keeps before it starts anew.
HELD_LINES = 20_000
BATCH = 30
RATE = 0.15
DECAY = 1e-4

#: Least share of texts in which a line stands that comes again.
OFTEN = 0.001
_BLANK, _BLANK_SQL = " \t\r", "' \\t\\r'"
_digits = re.compile("[0-9]+")
_word = re.compile(r"[㐀-鿿]+|[^\W\d_㐀-鿿]+(?:_\w+)?|\d+|[|·›»>/▾©…•]")
_link = re.compile(r"\[([^\]]*)\]\([^)]*\)")
_mark = re.compile(r"\s*(#{1,6} |[-*+›•»] ?|\d{1,3}[.)] |\||>)")
_separator = re.compile(r" [|·–›»>/] ")
_han = re.compile("[㐀-鿿]")
_letters = re.compile(r"[^\W\d_㐀-鿿]+")
_end = re.compile(r"[.!?。！？;；:：]['\"”’)]*$")
_sentence = re.compile(r"[.!?。！？](?=\s|$|[㐀-鿿])")


def han(text: str) -> int:
    """Number of ideographs."""
    return 0 if text.isascii() else len(_han.findall(text))


def line_features(line: str) -> tuple[str, tuple[str, ...]]:
    """Kind of a line, for its neighbours, and the features of its own text."""
    links = _link.findall(line)
    plain = _link.sub(r"\1", line)
    unlinked = _link.sub("", line).strip(" |·*-")
    text = plain.strip()
    m = _mark.match(plain)
    mark = "code" if plain.startswith(("    ", "\t")) or text.startswith("```") else "none"
    if m and mark == "none":
        c = m.group(1).strip()
        mark = "head" + str(len(c)) if c[0] == "#" else "row" if c == "|" else "num" if c[0].isdigit() else c
        if mark != "row":
            text = plain[m.end() :].strip()
    words = _word.findall(text)
    cjk = han(text)
    weight = cjk // 2 + sum(not ("㐀" <= w[0] <= "鿿") and w[0].isalpha() for w in words)
    size = 0 if weight <= 1 else 1 if weight <= 2 else 2 if weight <= 4 else 3 if weight <= 8 else 4 if weight <= 13 else 5
    stops = min(3, len(_sentence.findall(text)))
    ended = bool(_end.search(text))
    separators = sum(text.count(s) for s in (" | ", " · ", " › ", " » ", " > ", " / "))
    first = text[:1]
    case = "upper" if first.isupper() else "lower" if first.islower() else "digit" if first.isdigit() else "cjk" if "㐀" <= first <= "鿿" else "other"
    named = [w[0] for w in words if w[0].isalpha()]
    letters, capitals = len(named), sum(c.isupper() for c in named)
    share = "all" if letters and capitals == letters else "most" if letters and capitals * 2 >= letters else "few"
    out = [f"mark={mark}", f"size={size}", f"stops={stops}", f"end={ended}", f"sep={min(3, separators)}", f"case={case}", f"{mark}|{size}|{case}", f"{size}|{ended}|{stops}", f"sep={min(3, separators)}|{size}|{stops}", f"cap={share}|{size}"]
    if links:
        out += [f"links={min(3, len(links))}", f"onlylinks={not unlinked}"]
    if size >= 4 and ended and stops:
        out.append(f"prose|sep={min(2, separators)}")
    parts = [p for p in _separator.split(text) if p.strip()]
    longest = max((len(_letters.findall(p)) + han(p) // 2 for p in parts), default=0)
    widest = min(longest // 6, 4)
    out += [f"part={widest}", f"part={widest}|{min(len(parts), 4)}|{min(stops, 2)}"]
    low = [("9" if w.isdigit() else w.lower()) for w in words]
    short = size <= 3
    latin = [w for w in low if not "㐀" <= w[0] <= "鿿"]
    out += [f"w={w}" for w in set(latin)]
    # every word of a line counts; in short ones the pairs of words and the line as a whole do too
    if short:
        out += [f"s={w}" for w in set(latin)]
        out.append("line=" + " ".join(low))
    if short or len(latin) <= 14:
        out += [f"b={a} {b}" for a, b in zip(latin, latin[1:], strict=False)]
    out += [f"first={' '.join(low[:2])}", f"last={' '.join(low[-2:])}"]
    for run in (w for w in words if "㐀" <= w[0] <= "鿿"):
        out += [f"c={run[i : i + 2]}" for i in range(len(run) - 1)]
        if short:
            out.append(f"r={run}")
    kind = mark if mark != "none" else "links" if links and not unlinked else "prose" if size >= 4 and stops else "parts" if separators else f"short{min(size, 2)}{case}"
    return kind, tuple(dict.fromkeys(out))


def masked(line: str) -> str:
    """A line without white space at its ends and with its numbers made one, as the corpus counts it."""
    return _digits.sub("9", line.strip(_BLANK))


def context_features(lines: list[str], at: list[int], kinds: list[str], title: str | None, often: dict[str, int]) -> list[list[str]]:
    """Features of each line at ``at`` from its neighbours, its place, the page's title and how often it stands on pages."""
    around, named, out = ["start", *kinds, "end"], (title or "").strip(), []
    for j, i in enumerate(at):
        before, kind, after = around[j : j + 3]
        extra = [f"prev={before}", f"next={after}", f"{before}>{kind}", f"{kind}>{after}", f"pos={min(j, 3)}|{min(len(at) - 1 - j, 3)}", "bias"]
        level = often.get(masked(lines[i]), 0)
        extra += [f"often={level}", f"often={level}|{kind}"]
        if i and not lines[i - 1].strip():
            extra += ["gap", f"gap|{kind}"]
        if named and lines[i].strip(" #\r\t") == named:
            extra += ["title", f"title|{kind}", f"title|{after}"]
        out.append(extra)
    return out


def page_features(lines: list[str], title: str | None, often: dict[str, int]) -> tuple[list[int], list[list[str]]]:
    """Numbers (from 0) of the lines that are not blank, and the features of each."""
    at = [i for i, line in enumerate(lines) if line.strip()]
    own = [line_features(lines[i].rstrip("\r")) for i in at]
    extra = context_features(lines, at, [k for k, _ in own], title, often)
    return at, [[*features, *more] for (_, features), more in zip(own, extra, strict=True)]


def level(share: float) -> int:
    """How often a line stands on pages: 0 below OFTEN, 1 below 1 %, else 2."""
    return 0 if share < OFTEN else 1 if share < 0.01 else 2


def often_lines(df: DataFrame, texts: list[str]) -> dict[str, int]:
    """Masked lines of the text columns that stand in more than one text and at least OFTEN of all, with their level.

    As shares add up to the mean number of lines of a text, there are at most 1 / OFTEN times as many such lines.
    """
    mask = F.expr(f"transform(split(text, '\n'), x -> regexp_replace(trim({_BLANK_SQL} FROM x), '[0-9]+', '9'))")
    rows = df.select(F.explode(F.array(*texts)).alias("text")).where("text <> ''")
    total = rows.count()
    lines = rows.select(F.explode(F.array_distinct(mask)).alias("line")).where("line <> ''")
    counts = lines.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, OFTEN * total))
    return {r["line"]: level(r["n"] / total) for r in counts.collect()}


class Field:
    """Weights of features and transitions."""

    def __init__(self, number: dict[str, int], emit: np.ndarray, move: np.ndarray) -> None:
        self.number, self.emit, self.move = number, emit, move
        self.held: dict[str, tuple[str, np.ndarray]] = {}
        self.contexts: dict[tuple[str, ...], np.ndarray] = {}

    def weight(self, features: tuple[str, ...] | list[str]) -> np.ndarray:
        """Sum of the features' weights; those never met in training have none."""
        return self.emit[[n for f in features if (n := self.number.get(f)) is not None]].sum(axis=0)

    def scores(self, lines: list[str], title: str | None, often: dict[str, int]) -> tuple[list[int], np.ndarray]:
        """Numbers (from 0) of the lines that are not blank, and the score of each state for each of them.

        The weight of a line's own text is kept, as menus and footers come again on page after page.
        """
        at = [i for i, line in enumerate(lines) if line.strip()]
        kinds, out = [], np.zeros((len(at), STATES))
        for j, i in enumerate(at):
            line = lines[i].rstrip("\r")
            held = self.held.get(line)
            if held is None:
                kind, features = line_features(line)
                held = (kind, self.weight(features))
                if len(line) <= 1000:
                    if len(self.held) >= HELD_LINES:
                        self.held.clear()
                    self.held[line] = held
            kinds.append(held[0])
            out[j] = held[1]
        for j, extra in enumerate(context_features(lines, at, kinds, title, often)):
            key = tuple(extra)
            more = self.contexts.get(key)
            if more is None:
                if len(self.contexts) >= HELD_LINES:
                    self.contexts.clear()
                more = self.contexts[key] = self.weight(extra)
            out[j] += more
        return at, out

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The most likely states of one page."""
        rows, move = scores.tolist(), self.move.T.tolist()
        best, back = rows[0], []
        for row in rows[1:]:
            links, after = [], []
            for state in range(STATES):
                ways = [b + m for b, m in zip(best, move[state], strict=True)]
                top = max(ways)
                links.append(ways.index(top))
                after.append(top + row[state])
            back.append(links)
            best = after
        path = [best.index(max(best))]
        for links in reversed(back):
            path.append(links[path[-1]])
        return path[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(pages: list[tuple[list[tuple[str, int]], str]], epochs: int = EPOCHS, seed: int = 3) -> Field:
    """Weights that maximise the likelihood of the pages' labels, by stochastic gradients on batches of pages."""
    number: dict[str, int] = {}
    seen: dict[str, int] = {}
    data = []
    counts = Counter(m for lines, _ in pages for m in {masked(line) for line, _ in lines if line.strip()})
    often = {m: level(n / len(pages)) for m, n in counts.items() if n >= OFTEN * len(pages) and n > 1}
    for lines, title in pages:
        at, features = page_features([line for line, _ in lines], title, often)
        if at:
            data.append((features, np.array([lines[i][1] for i in at])))
            for names in features:
                for f in names:
                    seen[f] = seen.get(f, 0) + 1
    for f, n in seen.items():
        if n >= 2:
            number[f] = len(number)
    rows = [([[number[f] for f in names if f in number] for names in features], labels) for features, labels in data]
    emit, move = np.zeros((len(number), STATES)), np.zeros((STATES, STATES))
    emit_g, move_g = np.full(emit.shape, 1e-6), np.full(move.shape, 1e-6)
    order = np.random.default_rng(seed)
    for epoch in range(epochs):
        for batch in np.array_split(order.permutation(len(rows)), max(1, len(rows) // BATCH)):
            chosen = sorted((rows[i] for i in batch), key=lambda r: -len(r[1]))
            lengths = np.array([len(labels) for _, labels in chosen])
            size, longest = len(chosen), int(lengths[0])
            ids = np.concatenate([np.array(f) for features, _ in chosen for f in features])
            line = np.repeat(np.arange(int(lengths.sum())), [len(f) for features, _ in chosen for f in features])
            flat = np.stack([np.bincount(line, emit[ids, s], minlength=int(lengths.sum())) for s in range(STATES)], 1)
            scores = np.zeros((size, longest, STATES))
            inside = np.arange(longest)[None, :] < lengths[:, None]
            scores[inside] = flat
            labels = np.zeros((size, longest), np.int64)
            labels[inside] = np.concatenate([y for _, y in chosen])
            # forward and backward sums; pages are sorted by length, so the live ones are the first
            fore, back = np.zeros_like(scores), np.zeros_like(scores)
            fore[:, 0] = scores[:, 0]
            live = inside.sum(axis=0)
            for t in range(1, longest):
                k = live[t]
                fore[:k, t] = _log_sum(fore[:k, t - 1, :, None] + move, 1) + scores[:k, t]
            for t in range(longest - 2, -1, -1):
                k = live[t + 1]
                back[:k, t] = _log_sum(move + (scores[:k, t + 1] + back[:k, t + 1])[:, None, :], 2)
            total = _log_sum(fore[np.arange(size), lengths - 1], 1)
            state = np.exp(fore + back - total[:, None, None])
            gap = (np.eye(STATES)[labels] - state)[inside]
            grad = np.stack([np.bincount(ids, gap[line, s], minlength=len(number)) for s in range(STATES)], 1)
            pair = fore[:, :-1, :, None] + move + (scores + back)[:, 1:, None, :] - total[:, None, None, None]
            both = inside[:, 1:]
            move_grad = -np.exp(pair[both]).sum(axis=0)
            np.add.at(move_grad, (labels[:, :-1][both], labels[:, 1:][both]), 1)
            grad, move_grad = grad / size - DECAY * emit, move_grad / size - DECAY * move
            emit_g += grad**2
            move_g += move_grad**2
            emit += RATE * grad / np.sqrt(emit_g)
            move += RATE * move_grad / np.sqrt(move_g)
    return Field(number, emit, move)


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES) -> Field:
    """The field trained on that many labelled pages, once in a process."""
    return train(labelled_pages(pages))


def outside_lines(field: Field, text: str | None, title: str | None = None, often: dict[str, int] | None = None) -> list[int]:
    """Numbers, from 1, of the non-blank lines that hold nothing of the main body."""
    lines = (text or "").split("\n")
    at, scores = field.scores(lines, title, often or {})
    if not at:
        return []
    path = field.viterbi(scores)
    return [i + 1 for i, s in zip(at, path, strict=True) if s != BODY]


def find_boilerplate(df: DataFrame, key: str, title: str | None, texts: list[str], pages: int = TRAINING_PAGES) -> DataFrame:
    """(key, field, lines, body) for each text column of each row: the line numbers outside the main body, and the text without them.

    Lines end at LF and are counted from 1; blank lines are never listed. Null and empty texts have no lines
    and an empty body. Repeated rows give repeated rows. Only the named columns are read.
    """
    context = df.sparkSession.sparkContext
    field, often = context.broadcast(trained(pages)), context.broadcast(often_lines(df, texts))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, again = field.value, often.value
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                titles = part.column(1).to_pylist()
                for i, name in enumerate(texts):
                    found, bodies = [], []
                    for text, head in zip(part.column(2 + i).to_pylist(), titles, strict=True):
                        out = outside_lines(model, text, head, again)
                        gone = set(out)
                        found.append(out)
                        bodies.append("\n".join(line for n, line in enumerate((text or "").split("\n"), 1) if n not in gone))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([name] * len(found)), pa.array(found, pa.list_(pa.int32())), pa.array(bodies)], ["key", "field", "lines", "body"])

    rows = df.select(F.col(key).alias("key"), (F.col(title) if title else F.lit(None).cast("string")).alias("title"), *[F.col(c).alias(f"text_{i}") for i, c in enumerate(texts)])
    return skew.dealt(rows).mapInArrow(run, f"key {kind}, field string, lines array<int>, body string").withColumnRenamed("key", key)


def boilerplate_lines(found: DataFrame, key: str) -> DataFrame:
    """(key, field, line_no), distinct; texts are made distinct as whole lists of lines before these are unfolded."""
    rows = found.where(F.col(key).isNotNull() & (F.size("lines") > 0)).select(key, "field", "lines").distinct()
    return rows.select(key, "field", F.explode("lines").alias("line_no")).distinct()

"""Literals, verdicts and canonical calls out of texts and JSON, as column expressions; null is read as ''."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import evidence, terms, text, urls


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def labelled_values(c: Column) -> Column:
    """(label, value) pairs that a text writes as label: value or label = value, in order."""
    pattern = F.lit(r"(?:^|[\s,;|（(])([A-Za-z_][A-Za-z0-9_]{1,23}|[㐀-鿿]{1,12})[ \t]*[:：=][ \t]*([^\s,;，；。|/][^\s,;，；。|]*)")
    labels, values = (F.regexp_extract_all(_text(c), pattern, i) for i in (1, 2))
    return F.zip_with(labels, values, lambda a, b: F.struct(a.alias("label"), b.alias("value")))


def quantities(c: Column) -> Column:
    """Numbers with a unit, in order."""
    return F.regexp_extract_all(_text(c), F.lit(r"\d+(?:\.\d+)?[ \t]*(?:%|ms|MB|GB|days?|hours?|条|组|秒|天)"), 0)


def literal_claims(c: Column) -> Column:
    """The days and versions that a text names, as date:... and version:..., each once."""
    return F.concat(F.transform(text.dates_in(c), lambda d: F.concat(F.lit("date:"), d)), F.transform(terms.plain_versions(c), lambda v: F.concat(F.lit("version:"), v)))


def named_hosts(c: Column) -> Column:
    """Hosts that URLs and site: operators in a text name, as host:..., each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(_text(c)), F.lit(r"(?:site:|https?://)([a-z0-9-]+(?:\.[a-z0-9-]+)+)"), 1), lambda h: F.concat(F.lit("host:"), h)))


def alignment(asked: Column, seen: Column) -> Column:
    """How typed identifiers (kind:value) that were asked for meet those seen: 'exact' for a common one, 'conflict' for a common kind only, else 'unresolved'; 'not_requested' if none was asked for."""
    kinds = lambda c: F.array_distinct(F.transform(c, lambda x: F.substring_index(x, ":", 1)))
    return F.when(F.size(asked) == 0, "not_requested").when(F.arrays_overlap(asked, seen), "exact").when(F.arrays_overlap(kinds(asked), kinds(seen)), "conflict").otherwise("unresolved")


def answer_verdict(c: Column, least: int = 80) -> Column:
    """(issues, verdict) of an answer: empty and prompt remains fail, refusals, missing citations and short texts are to be reviewed."""
    t = _text(c)
    empty, refusal, protocol = t.rlike(r"^[\s\p{Z}]*$"), t.rlike(evidence.REFUSAL), t.rlike(evidence.PROTOCOL)
    uncited, short = ~t.rlike(r"https?://|\[S?\d+\]"), F.length(t) < least
    issues = F.array_compact(F.array(*[F.when(x, name) for x, name in ((empty, "empty"), (refusal, "refusal"), (protocol, "protocol"), (uncited, "uncited"), (short, "short"))]))
    return F.struct(F.array_join(issues, ",").alias("issues"), F.when(empty | protocol, "fail").when(refusal | uncited | short, "review").otherwise("pass").alias("verdict"))


def anchor_window(c: Column, anchor: Column, before: int = 1, after: int = 2) -> Column:
    """(line_no, lines): the first line that names a version, with lines around it; nulls if none does."""
    lines = F.split(_text(c), "\n")
    hits = F.filter(F.transform(lines, lambda x, i: F.when(F.array_contains(F.regexp_extract_all(x, F.lit("[0-9.]+"), 0), anchor), i + 1)), lambda i: i.isNotNull())
    first = F.try_element_at(hits, F.lit(1))
    start = F.greatest(first - before, F.lit(1))
    return F.struct(first.alias("line_no"), F.array_join(F.slice(lines, start, first + after - start + 1), "\n").alias("lines"))


def canonical_call(c: Column, names: list[str], arguments: list[str]) -> Column:
    """(tool, conflict, argument) of a call in JSON that may have the tool and its argument under several names; the first non-empty counts."""
    found = lambda paths: F.filter(F.array(*[F.get_json_object(c, f"$.{p}") for p in paths]), lambda x: F.coalesce(x, F.lit("")) != "")
    tools = found(names)
    return F.struct(F.try_element_at(tools, F.lit(1)).alias("tool"), (F.size(F.array_distinct(tools)) > 1).alias("conflict"), F.try_element_at(found(arguments), F.lit(1)).alias("argument"))


def chunk_score(c: Column, terms_: Column) -> Column:
    """Points of a chunk: 4 for each term, at most 32; 24 and 3 for each date, and the same for versions, at most 40 each."""
    low = F.lower(_text(c))
    hits = F.least(F.lit(32), 4 * F.size(F.filter(terms_, lambda t: F.contains(low, t))))
    of = lambda n: F.when(n > 0, 24 + F.least(F.lit(16), 3 * n)).otherwise(0)
    return hits + of(F.regexp_count(_text(c), F.lit(r"\d{4}-\d{2}-\d{2}"))) + of(F.size(terms.plain_versions(c)))


def upserted(df: DataFrame, changes: DataFrame, key: str, flag: str) -> DataFrame:
    """``df`` with the rows of ``changes`` put in by key: their non-null values replace, unknown keys are added; ``flag`` tells which rows changed.

    Keys are to be unique in both. Columns that ``changes`` lacks keep their values.
    """
    other = changes.select(*[F.col(c).alias(f"__{c}") for c in changes.columns])
    joined = df.join(other, F.col(key) == F.col(f"__{key}"), "full")
    return joined.select(*[(F.coalesce(f"__{c}", c) if c in changes.columns else F.col(c)).alias(c) for c in df.columns], F.col(f"__{key}").isNotNull().alias(flag))


def bounded_quote(c: Column, size: int = 800, reach: int = 240) -> Column:
    """A text of more than ``size`` characters up to the first sentence end within ``reach`` beyond, else to the last one, else the last space, of its second half; else cut hard."""
    t = F.regexp_replace(F.regexp_replace(_text(c), "\r\n?", "\n"), r"^\s+|\s+$", "")
    head, rest = F.substring(t, 1, size), F.substring(t, size + 1, reach)
    beyond = F.length(F.regexp_extract(rest, r"(?s)^(.*?[.!?。！？；;](?:(?=\s)|$))", 1))
    back, space = F.length(F.regexp_extract(head, r"(?s)^(.*[.!?。！？；;](?:(?=\s)|$))", 1)), F.length(F.regexp_extract(head, r"(?s)^(.*) ", 1))
    cut = F.when(beyond > 0, size + beyond).when(back >= size // 2, back).when(space >= size // 2, space).otherwise(size)
    return F.when(F.length(t) <= size, t).otherwise(F.regexp_replace(F.substring(t, F.lit(1), cut), r"\s+$", ""))


def site_allows(url: Column, query: Column) -> Column:
    """Whether a URL lies within the site that a query names by site:; true if it names none."""
    site = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(_text(query), r"(?i)(?:^|\s)site:([A-Za-z0-9.-]+)", 1)), r"^www\.", ""), r"\.+$", "")
    return (site == "") | urls.host_within(urls.host(url), site)


def package_name(c: Column, registry: str) -> Column:
    """The package that a request names for a registry (crates, pypi, npm): by its URL, after the registry's name, or as the whole request; '' if none."""
    t = F.trim(F.regexp_replace(_text(c), r"[\s\p{Z}]+", " "))
    at = {"crates": r"(?i)^https?://(?:www\.)?crates\.io/crates/([^/?#]+)", "pypi": r"(?i)^https?://(?:www\.)?pypi\.org/(?:project|pypi)/([^/?#]+)", "npm": r"(?i)^https?://(?:www\.)?npmjs\.com/package/(@[^/?#]+/[^/?#]+|[^/@?#]+)"}[registry]
    after = {"crates": r"(?i)\bcrates\.io(?: 上)? ([A-Za-z0-9_.-]+)", "pypi": r"(?i)\bPyPI(?: 上)? ([A-Za-z0-9_.-]+)", "npm": r"(?i)\bnpm(?: 上)? (@?[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)?)"}[registry]
    found = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (at, after)]
    return F.coalesce(*found, F.when(t.rlike(r"^@?[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)?$"), t), F.lit(""))


def option_score(total: Column, count: Column, first: Column, quote: Column, method: str, weight: float = 1.0) -> Column:
    """Score of an option from its log probabilities: their 'sum', 'mean', 'sqrt_mean' (over the root of their number), 'first', or 'query_sqrt_mean', which adds ``weight`` times the quote's score."""
    rooted = total / F.sqrt(count)
    ways = {"sum": total, "mean": total / count, "sqrt_mean": rooted, "first": first, "query_sqrt_mean": rooted + weight * quote}
    if method not in ways:
        raise ValueError(f"no method {method}; one of {', '.join(ways)}")
    return ways[method]

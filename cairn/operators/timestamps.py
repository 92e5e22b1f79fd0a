"""Timestamps of mixed formats, precisions and zones as one UTC instant, on the JVM throughout.

A value is rewritten by every format that fits it into one canonical row of fields; each row that names a
possible day and time becomes a candidate instant. Values with one candidate are settled. For the others the
mixture of formats of their source is estimated by expectation-maximisation: each value counts for each of its
valid readings with the posterior of that reading, starting from equal weights. A posterior of at least
``certainty`` chooses a reading, anything less is marked as ambiguous. The estimate runs on counts by source
and set of readings, so its input is small however many values there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 25
SMOOTHING = 0.5
CERTAINTY = 0.9

#: Month names and their short forms.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8,
    "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "januar": 1, "jänner": 1, "februar": 2, "märz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12,
    "mär": 3, "mrz": 3, "okt": 10, "dez": 12,
}
#: Minutes east of UTC of zone abbreviations.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "hkt": 480, "sgt": 480, "awst": 480, "jst": 540, "kst": 540,
    "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "akst": -540, "akdt": -480, "hst": -600, "ast": -240, "adt": -180, "brt": -180, "art": -180,
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"((?:(?:[Uu][Tt][Cc]|[Gg][Mm][Tt])?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{1,5})?(?:\[[^\[\]|]+\])?)"
_HALF = r"([AaPp]\.?[Mm]\.?)?"
_DAYNAME = r"(?:\p{L}{2,10}\.?,? )?"

#: Format, pattern, and how its groups fill year|month|day|hour|minute|second|fraction|half|zone.
FORMATS: tuple[tuple[str, str, str], ...] = (
    ("iso", rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt ]{_TIME} ?{_HALF})? ?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("iso_basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt ](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("digits", r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})?$", "$1|$2|$3|$4|$5|$6|||"),
    ("year_first", rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}})(?:[Tt ]{_TIME} ?{_HALF} ?{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("dotted", rf"^{_DAYNAME}(\d{{1,2}})\. ?(\d{{1,2}})\. ?(\d{{4}})(?:,? (?:um )?{_TIME}(?: Uhr)? ?{_HALF} ?{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("day_first", rf"^(\d{{1,2}})([/-])(\d{{1,2}})\2(\d{{4}})(?:,? {_TIME} ?{_HALF} ?{_ZONE})?$", "$4|$3|$1|$5|$6|$7|$8|$9|$10"),
    ("month_first", rf"^(\d{{1,2}})([/-])(\d{{1,2}})\2(\d{{4}})(?:,? {_TIME} ?{_HALF} ?{_ZONE})?$", "$4|$1|$3|$5|$6|$7|$8|$9|$10"),
    ("day_month_name", rf"^{_DAYNAME}(\d{{1,2}})(?:\.|st|nd|rd|th)? (\p{{L}}{{3,9}})\.?,? (\d{{4}})(?:,? (?:at |um )?{_TIME}(?: Uhr)? ?{_HALF} ?{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("month_name_day", rf"^{_DAYNAME}(\p{{L}}{{3,9}})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?:,? (?:at )?{_TIME} ?{_HALF} ?{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("cjk", rf"^(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})[日号](?: ?(?:星期|周).)? ?(上午|下午|凌晨|早上|中午|晚上)? ?(?:(\d{{1,2}})[时点:](\d{{1,2}})?分?(?::?(\d{{1,2}})秒?)? ?{_ZONE})?$", "$1|$2|$3|$5|$6|$7||$4|$8"),
    ("seconds", r"^(\d{9,10})(?:\.(\d+))?$", "$1||||||$2||"),
    ("milliseconds", r"^(\d{12,13})(?:\.(\d+))?$", "$1||||||$2||"),
    ("microseconds", r"^(\d{15,16})(?:\.(\d+))?$", "$1||||||$2||"),
)
#: Values that more than one format can read.
_SHARED = r"^(\d{1,2}[/-]\d{1,2}[/-]\d{4}\D.*|\d{1,2}[/-]\d{1,2}[/-]\d{4}|\d{12})$"
#: Formats that read no other values than these, and all that may read one of them.
_ONLY_SHARED = ("day_first", "month_first")
_OFTEN_SHARED = (*_ONLY_SHARED, "digits", "milliseconds")
_WIDE = "０１２３４５６７８９：－＋／．，Ｔ　 ﹣−"
_NARROW = "0123456789:-+/.,T  --"


def cleaned(value: Column) -> Column:
    """Value with wide characters made narrow and white space trimmed and collapsed."""
    return F.trim(F.regexp_replace(F.translate(value, _WIDE, _NARROW), r"\s+", " "))


def _number(c: Column) -> Column:
    return F.when(c != "", c.cast("bigint"))


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _clock(at: Callable[[int], Column]) -> Column:
    """Microseconds of the clock that fields 0 to 7 name, as if it were UTC; null for impossible days and times."""
    month = F.coalesce(F.when(at(1).rlike(r"^\d+$"), at(1).cast("int")), _lookup(MONTHS, F.lower(at(1))))
    day = F.try_to_date(F.format_string("%s-%02d-%02d", at(0), month, _number(at(2))), "yyyy-MM-dd")
    half = F.lower(F.regexp_replace(at(7), r"\.", ""))
    numbers = F.struct(*[F.coalesce(_number(at(i)), F.lit(0).cast("bigint")).alias(name) for i, name in ((3, "h"), (4, "m"), (5, "s"))], half.alias("half"), day.alias("day"))

    def micros(n: Column) -> Column:
        early, late, noon = n["half"].isin("am", "上午", "凌晨", "早上"), n["half"].isin("pm", "下午", "晚上"), n["half"] == "中午"
        hour = F.when(early & (n["h"] == 12), 0).when((late & (n["h"] < 12)) | (noon & (n["h"] < 10)), n["h"] + 12).otherwise(n["h"])
        latin = n["half"].isin("am", "pm") & ((n["h"] < 1) | (n["h"] > 12))
        possible = (n["h"] < 24) & (n["m"] < 60) & (n["s"] < 60) & ~latin & ~(early & (n["h"] > 12))
        seconds = F.datediff(n["day"], F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400 + hour * 3600 + n["m"] * 60 + n["s"]
        return F.when(possible, seconds * 1_000_000 + _fraction(at(6), 6))

    return _let(numbers, micros)


def _fraction(digits: Column, places: int) -> Column:
    return F.coalesce(_number(F.when(digits != "", F.rpad(F.substring(digits, 1, places), places, "0"))), F.lit(0).cast("bigint"))


def _offset(signed: Column) -> Column:
    """Minutes east of UTC of +h, +hh, +hhmm or +hh:mm; null beyond 14 hours."""
    digits = F.regexp_replace(signed, r"[+:-]", "")
    hours = F.when(F.length(digits) <= 2, digits).otherwise(F.regexp_replace(digits, r"\d\d$", ""))
    minutes = F.when(F.length(digits) > 2, F.regexp_extract(digits, r"(\d\d)$", 1)).otherwise("0")
    total = _number(hours) * 60 + _number(minutes)
    return F.when((total <= 14 * 60) & (_number(minutes) < 60), total * F.when(signed.startswith("-"), -1).otherwise(1))


def _instant(fields: Column, wall_zone: Column, zones: list[str]) -> Column:
    """Microseconds since 1970 UTC that format and fields name, or null."""
    at = lambda i: F.element_at(fields, i + 2)
    kind = F.element_at(fields, 1)
    plain = F.lower(F.regexp_replace(at(8), r"\[.*", ""))
    named = F.struct(
        _clock(at).alias("local"), plain.alias("plain"), F.regexp_extract(plain, r"^(?:utc|gmt)?([+-]\d{1,2}(?::?\d{2})?)$", 1).alias("signed"),
        F.coalesce(F.nullif(F.regexp_extract(at(8), r"\[([^\]]+)\]", 1), F.lit("")), wall_zone, F.lit("UTC")).alias("zone"),
    )

    def fixed(n: Column) -> Column:
        by_name = F.when((n["plain"] == "cst") & (wall_zone == "Asia/Shanghai"), 480).otherwise(_lookup(ABBREVIATIONS, n["plain"]))
        return n["local"] - F.when(n["signed"] != "", _offset(n["signed"])).otherwise(by_name) * 60_000_000

    def zoned(n: Column) -> Column:
        wall = F.timestamp_micros(n["local"])
        there = _let(F.to_utc_timestamp(wall, n["zone"]), lambda t: F.when(F.from_utc_timestamp(t, n["zone"]) == wall, F.unix_micros(t)))
        # one literal is searched, as a list of all names would make the plan hundreds of times larger
        known = ~F.contains(n["zone"], F.lit("|")) & (F.instr(F.lit("|" + "|".join(zones) + "|"), F.concat(F.lit("|"), n["zone"], F.lit("|"))) > 0)
        return F.when(known, there)

    counted = F.when(kind == "seconds", _number(at(0)) * 1_000_000 + _fraction(at(6), 6))
    counted = counted.when(kind == "milliseconds", _number(at(0)) * 1000 + _fraction(at(6), 3)).when(kind == "microseconds", _number(at(0)))
    return F.when(kind.isin("seconds", "milliseconds", "microseconds"), counted).otherwise(_let(named, lambda n: F.when(n["plain"] != "", fixed(n)).otherwise(zoned(n))))


def readings(text: Column, wall_zone: Column, zones: list[str], formats: list[tuple[str, str, str]]) -> Column:
    """Array of (format, instant_us) of the formats by which ``text`` names an instant."""
    fits = F.array_compact(F.array(*[F.when(text.rlike(pattern), F.concat(F.lit(name + "|"), F.regexp_replace(text, pattern, fill))) for name, pattern, fill in formats]))
    read = F.transform(fits, lambda c: _let(F.split(c, r"\|", -1), lambda f: F.struct(F.element_at(f, 1).alias("format"), _instant(f, wall_zone, zones).alias("instant_us"))))
    return F.filter(read, lambda r: r["instant_us"].isNotNull())


def _weights(groups: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Weight of each format by source, from its sets of readings and their counts."""
    for sets, counts in groups:
        out = []
        for readings, n in zip(sets, counts, strict=True):
            names = sorted({f for s in readings for f in s})
            place = {f: i for i, f in enumerate(names)}
            member = np.array([[f in s for f in names] for s in readings], float)
            n = np.asarray(n, float)
            weight = np.full(len(names), 1 / len(names))
            for _ in range(ROUNDS):
                share = member * weight
                share /= share.sum(axis=1, keepdims=True)
                weight = (n @ share + SMOOTHING) / (n.sum() + SMOOTHING * len(names))
            out.append({f: float(weight[place[f]]) for f in names})
        yield pd.Series(out)


def zone_names(df: DataFrame) -> list[str]:
    """Names of the zones that this Java knows."""
    return sorted(df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())


def timestamp_values(df: DataFrame, key: str, fields: dict[str, Column], wall_zone: Column, source: Column) -> DataFrame:
    """(record_id, source, wall_zone, field, value): a row for each value of ``fields``."""
    values = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), value.alias("value")) for name, value in fields.items()])).alias("v")
    flat = df.select(F.col(key).alias("record_id"), source.alias("source"), wall_zone.alias("wall_zone"), values)
    return flat.select("record_id", "source", "wall_zone", "v.field", "v.value")


def normalise_timestamps(df: DataFrame, key: str, fields: dict[str, Column], wall_zone: Column, source: Column, certainty: float = CERTAINTY) -> DataFrame:
    """Rows (record_id, field, value, status, format, posterior, instant_us), one for each value of ``fields``.

    ``status`` is 'resolved', 'ambiguous' (several readings, none certain), or 'none' for a value, null and
    empty ones included, that names no instant: parts of dates, relative phrases, impossible dates, times and
    offsets, and clock times that its zone skips. ``instant_us`` is given for resolved values only and cut
    off at microseconds. An offset, abbreviation or zone in the value decides; else the clock is that of
    ``wall_zone``, UTC if that is null; an unknown zone gives 'none'. A clock time that occurs twice is its first
    occurrence, a day alone its 00:00, a dotted date day first. White space is trimmed and collapsed first, and a
    value may be of any length. Repeated rows are repeated.
    """
    return normalise_values(timestamp_values(df, key, fields, wall_zone, source), certainty)


def normalise_values(values: DataFrame, certainty: float = CERTAINTY) -> DataFrame:
    """:func:`normalise_timestamps` of rows as :func:`timestamp_values` gives them."""
    zones = zone_names(values)
    flat = values.withColumn("text", cleaned(F.col("value"))).withColumn("shared", F.coalesce(F.col("text").rlike(_SHARED), F.lit(False)))

    def read(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
        # the explode keeps the readings from being computed once for each use
        found = readings(F.col("text"), F.col("wall_zone"), zones, [f for f in FORMATS if f[0] in names])
        return rows.select("record_id", "source", "field", "value", F.explode(F.array(F.coalesce(found, F.array()))).alias("read"))

    first = F.try_element_at("read", F.lit(1))
    named = first.isNotNull()
    single = read(flat.where(~F.col("shared")), tuple(f[0] for f in FORMATS if f[0] not in _ONLY_SHARED))
    single = single.select("record_id", "field", "value", F.when(named, "resolved").otherwise("none").alias("status"), first["format"].alias("format"), F.when(named, F.lit(1.0)).alias("posterior"), first["instant_us"].alias("instant_us"))

    several = read(flat.where("shared"), _OFTEN_SHARED)
    counts = several.where(F.size("read") > 0).groupBy("source", F.col("read.format").alias("formats")).agg(F.count("*").alias("n"))
    weights = F.pandas_udf(_weights, "map<string, double>")
    mixture = counts.groupBy("source").agg(F.collect_list("formats").alias("sets"), F.collect_list("n").alias("n")).select(F.col("source").alias("of"), weights("sets", "n").alias("weight"))
    joined = several.join(mixture, F.col("source").eqNullSafe(F.col("of")), "left")
    weight = lambda f: F.coalesce(F.try_element_at("weight", f), F.lit(0.0))
    total = F.aggregate("read", F.lit(0.0), lambda s, r: s + weight(r["format"]))
    agreed = F.size(F.array_distinct(F.col("read.instant_us"))) == 1
    best = F.array_max(F.transform("read", lambda r: F.struct((weight(r["format"]) / total).alias("posterior"), r["format"].alias("format"), r["instant_us"].alias("instant_us"))))
    chosen = joined.withColumn("best", F.when(F.size("read") > 0, best)).withColumn("sure", agreed | (F.col("best.posterior") >= certainty))
    status = F.when(F.col("best").isNull(), "none").when(F.col("sure"), "resolved").otherwise("ambiguous")
    settled = chosen.select("record_id", "field", "value", status.alias("status"), "best.format", "best.posterior", F.when(F.col("sure"), F.col("best.instant_us")).alias("instant_us"))
    return single.unionByName(settled)

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from cairn.operators import timestamps as T
from pyspark.sql import functions as F


def read(spark, values, **options):
    """Instants by number of (value, wall zone, source)."""
    df = spark.createDataFrame([(i, v, z, s) for i, (v, z, s) in enumerate(values)], "id int, value string, wall_zone string, source string")
    out = T.normalise_timestamps(df, "id", {"f": F.col("value")}, F.col("wall_zone"), F.col("source"), **options).collect()
    assert len(out) == len(values)
    return {r["record_id"]: r for r in out}


def micros(*args, zone="UTC"):
    at = datetime(*args, tzinfo=ZoneInfo(zone)).astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)
    return at // timedelta(microseconds=1)


NAMED = [
    ("2025-01-19T05:29:40+08:00", None, micros(2025, 1, 18, 21, 29, 40)),
    (" 2026-01-15t16:26:09z\n", "Asia/Tokyo", micros(2026, 1, 15, 16, 26, 9)),
    ("2025-09-18T22:39:38.149875999Z", None, micros(2025, 9, 18, 22, 39, 38, 149875)),
    ("2025-07-01 08:00:00", "America/New_York", micros(2025, 7, 1, 8, zone="America/New_York")),
    ("2025-07-01T08:00", None, micros(2025, 7, 1, 8)),
    ("2025/10/23 10:28:27", "Europe/Berlin", micros(2025, 10, 23, 10, 28, 27, zone="Europe/Berlin")),
    ("04.01.2026 12:01", None, micros(2026, 1, 4, 12, 1)),
    ("20241124", "Asia/Shanghai", micros(2024, 11, 24, zone="Asia/Shanghai")),
    ("20240322T050918Z", "Asia/Shanghai", micros(2024, 3, 22, 5, 9, 18)),
    ("1754407668", "Asia/Tokyo", 1754407668 * 10**6),
    ("1762681264.43", None, 1762681264430000),
    ("1754750906857", None, 1754750906857000),
    ("1731768836523314", None, 1731768836523314),
    ("Wed, 27 Aug 2025 14:45:09 EDT", None, micros(2025, 8, 27, 18, 45, 9)),
    ("Sun, 26 Apr 2026 16:01:01 -0400", None, micros(2026, 4, 26, 20, 1, 1)),
    ("18. Dezember 2024, 14:01 Uhr", "Europe/Berlin", micros(2024, 12, 18, 13, 1)),
    ("1. März 2026, 15:29 Uhr", None, micros(2026, 3, 1, 15, 29)),
    ("2025-08-13T03:11:19[Asia/Shanghai]", "UTC", micros(2025, 8, 12, 19, 11, 19)),
    ("2024年11月26日 上午12:51", None, micros(2024, 11, 26, 0, 51)),
    ("2025年9月6日 下午9:22", None, micros(2025, 9, 6, 21, 22)),
    ("2025年8月18日 05时06分", None, micros(2025, 8, 18, 5, 6)),
    ("Mar 27, 2025 6:02 AM EDT", None, micros(2025, 3, 27, 10, 2)),
    ("December 13, 2024 12:56 PM", None, micros(2024, 12, 13, 12, 56)),
    ("10 November 2025", "Asia/Kolkata", micros(2025, 11, 10, zone="Asia/Kolkata")),
    ("2024-12-17 18:34:40 GMT+5:30", None, micros(2024, 12, 17, 13, 4, 40)),
    ("２０２４－０８－２４Ｔ１１：０１：５０＋００：００", None, micros(2024, 8, 24, 11, 1, 50)),
    ("2025-10-26 02:30:00", "Europe/Berlin", micros(2025, 10, 26, 0, 30)),  # twice: the first
    ("2024-02-29", None, micros(2024, 2, 29)),
    ("2025-05-16 03:32 PM EDT", None, micros(2025, 5, 16, 19, 32)),
    ("2025/05/16 12:05:09 am", "Asia/Tokyo", micros(2025, 5, 15, 15, 5, 9)),
    ("16.05.2025, 3:32 p.m. +02:00", None, micros(2025, 5, 16, 13, 32)),
    ("2025-05-16+02:00", None, micros(2025, 5, 15, 22)),
    ("20250516T1530Z", None, micros(2025, 5, 16, 15, 30)),
    ("20250516153001", "Asia/Tokyo", micros(2025, 5, 16, 6, 30, 1)),
    ("Friday, May 16th, 2025 at 3:32 PM", None, micros(2025, 5, 16, 15, 32)),
    ("2025年5月16日 星期五 15:32:01 +0800", None, micros(2025, 5, 16, 7, 32, 1)),
]
NONE = [
    None, "", "  ", "2025-03-30 02:30:00", "2024-17-02", "2025-02-29", "2024-05-28T25:21:00Z", "2025-04-08T10:91:00Z", "2026-06", "2025年10月", "2026", "Q4 2024", "yesterday", "26 hours ago", "vor 14 Tagen", "刚刚",
    "01:41:29", "null", "n/a", "Mar 27, 2025 13:02 PM", "Mar 27, 2025 0:02 AM", "2025-01-19T05:29:40+19:00", "2025-01-19T05:29:40 XYZ", "2025-01-19T05:29:40[Nowhere/City]", "20241345", "31 February 2025", "x" * 5000,
]


def test_named_instants(spark):
    got = read(spark, [(v, z, "s") for v, z, _ in NAMED])
    for i, (value, _, want) in enumerate(NAMED):
        assert (got[i]["status"], got[i]["instant_us"]) == ("resolved", want), value


def test_values_that_name_none(spark):
    got = read(spark, [(v, "Europe/Berlin", "s") for v in NONE] + [("2025-01-01 10:00", "No/Zone", "s")])
    for i, value in enumerate(NONE):
        assert (got[i]["status"], got[i]["instant_us"]) == ("none", None), value
    assert got[len(NONE)]["status"] == "none"


def test_mixture_decides_and_marks(spark):
    values = [("25/12/2024", None, "a"), ("13/01/2025", None, "a"), ("31/01/2025", None, "a"), ("28/02/2025", None, "a"), ("03/04/2025", None, "a")]
    values += [("12/25/2024", None, "b")] * 6 + [("03/04/2025", None, "b"), ("03/04/2025", None, None), ("05/05/2025", None, "c"), ("40/40/2025", None, "c")]
    got = read(spark, values, certainty=0.85)
    assert got[4]["instant_us"] == micros(2025, 4, 3) and got[4]["format"] == "day_first"
    assert got[11]["instant_us"] == micros(2025, 3, 4) and got[11]["posterior"] > 0.85
    assert got[12]["status"] == "ambiguous" and got[12]["instant_us"] is None
    assert got[13]["instant_us"] == micros(2025, 5, 5)
    assert got[14]["status"] == "none"


def test_session_zone_changes_nothing(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        test_named_instants(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, value string, wall_zone string, source string")
    assert T.normalise_timestamps(df, "id", {"f": F.col("value")}, F.col("wall_zone"), F.col("source")).count() == 0


def test_values_of_any_length(spark):
    got = read(spark, [(" " * 120 + "2025-07-01" + " " * 60 + "08:00:00" + "\n" * 90, None, "s"), ("　" * 101 + "2025-07-01T08:00", None, "s"), ("2025-07-01T08:00:00." + "0" * 200 + "Z", None, "s"), ("2025-07-01 " + "x" * 100, None, "s")])
    assert [(got[i]["status"], got[i]["instant_us"]) for i in range(4)] == [("resolved", micros(2025, 7, 1, 8))] * 3 + [("none", None)]

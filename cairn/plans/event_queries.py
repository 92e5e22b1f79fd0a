"""Queries on the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import eventlog, ordered
from cairn.plans.catalog import query
from cairn.sources.tables import table

SECONDS_SQL = "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)"


def _seconds() -> Column:
    return F.floor(F.unix_micros("ts") / 1_000_000)


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 1000")
def event_tail(spark: SparkSession, folder: str) -> DataFrame:
    """The events after a cursor; the condition is pushed down to the scan."""
    return table(spark, folder, "events").where("event_id > 1000").select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def event_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """The sequence number that each event gets in its user's log."""
    rows = _events(spark, folder).select("event_id", "user_id", "ts")
    return ordered.numbered(rows, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "seq")


@query(
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99
FROM events GROUP BY event_type"""
)
def group_scores_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Count, mean and nearest-rank percentiles by type."""
    rows = table(spark, folder, "events").select("event_type", "value")
    means = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    ranks = ordered.nearest_rank(rows, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return means.join(ranks, "event_type", "left")


@query(
    """SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate,
       round(avg(CASE WHEN event_type = 'error' THEN value END), 6) AS mean_error, max(event_id) FILTER (event_type = 'error') AS last_error FROM events GROUP BY user_id"""
)
def ops_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, failure rate and last failure by user; undefined means are null."""
    failed = F.col("event_type") == "error"
    return table(spark, folder, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(failed).alias("errors"), F.round(F.count_if(failed) / F.count("*"), 6).alias("error_rate"),
        F.round(F.avg(F.when(failed, F.col("value"))), 6).alias("mean_error"), F.max(F.when(failed, F.col("event_id"))).alias("last_error"),
    )


@query(
    """WITH m AS (SELECT 'events_' || event_type AS name, count(*) AS v FROM events GROUP BY event_type), f AS (SELECT 'cairn_' || regexp_replace(lower(name), '[^a-z0-9_]', '_', 'g') AS metric, v FROM m)
SELECT metric, 0 AS part, '# TYPE ' || metric || ' gauge' AS line FROM f UNION ALL SELECT metric, 1, metric || ' ' || CAST(v AS VARCHAR) FROM f"""
)
def metric_exposition(spark: SparkSession, folder: str) -> DataFrame:
    """Event counts in the text exposition format."""
    counts = table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("v")).select(F.concat(F.lit("events_"), "event_type").alias("name"), "v")
    return eventlog.exposition(counts, "name", "v")


@query(
    f"""SELECT event_id, event_type, round(sum(value) OVER w, 4) AS value_15min, count(*) OVER w AS n_15min
FROM (SELECT *, {SECONDS_SQL} AS s FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY s RANGE BETWEEN 900 PRECEDING AND CURRENT ROW)"""
)
def sliding_15min(spark: SparkSession, folder: str) -> DataFrame:
    """Sum and number of the events of the same type in the fifteen minutes up to each event."""
    rows = _events(spark, folder).select("event_id", "event_type", "value", _seconds().alias("s"), F.lit(1).alias("one"))
    out = ordered.trailing_sums(rows, ["event_type"], "s", 900, {"value_15min": "value", "n_15min": "one"})
    return out.select("event_id", "event_type", F.round("value_15min", 4).alias("value_15min"), "n_15min")


@query(
    """SELECT event_id, user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier,
       row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS repeated FROM events"""
)
def repeat_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often an event's kind was seen before for its user."""
    rows = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    out = ordered.numbered(rows, ["user_id", "event_type"], ["event_id"], "seq")
    return out.select("event_id", "user_id", "event_type", (F.col("seq") - 1).alias("earlier"), (F.col("seq") > 1).alias("repeated"))


@query(
    """SELECT user_id, count(*) FILTER (event_id <= before) AS n_breaks, count(*) AS n FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY user_id"""
)
def sequence_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """How often a user's event numbers fail to rise with time."""
    rows = _events(spark, folder).select("user_id", "ts", "event_id")
    seen = ordered.previous(rows, ["user_id"], ["ts", "event_id"], "event_id", "before")
    return seen.groupBy("user_id").agg(F.count_if(F.col("event_id") <= F.col("before")).alias("n_breaks"), F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a, row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY event_id) AS b FROM events),
i AS (SELECT user_id, a - b AS island, count(*) AS n FROM r WHERE event_type = 'error' GROUP BY ALL)
SELECT u.user_id, coalesce(max(i.n), 0) AS longest_run FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN i ON i.user_id = u.user_id GROUP BY u.user_id"""
)
def longest_error_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The longest run of consecutive failures of each user."""
    rows = table(spark, folder, "events").select("user_id", "event_id", "event_type")
    return eventlog.longest_runs(rows, ["user_id"], ["event_id"], F.col("event_type") == "error")


@query(
    """SELECT user_id, arg_max(value, event_id) FILTER (value IS NOT NULL) AS value, arg_max(props, event_id) FILTER (props IS NOT NULL) AS props
FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'"""
)
def changelog_compaction(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of each user, without those whose last event is a tombstone."""
    return eventlog.compact(table(spark, folder, "events"), "user_id", "event_id", ["value", "props"], F.col("event_type") == "error")


@query(
    f"""WITH e AS (SELECT user_id, {SECONDS_SQL} AS a, {SECONDS_SQL} + CAST(floor(value) AS BIGINT) AS b FROM events WHERE value >= 0),
g AS (SELECT user_id, a, max(b) AS b FROM e GROUP BY user_id, a),
w AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g)
SELECT user_id, CAST(sum(CASE WHEN reach IS NULL OR reach < a THEN b - a ELSE greatest(b - reach, 0) END) AS BIGINT) AS covered, CAST(sum(CASE WHEN reach IS NULL OR reach < a THEN 1 ELSE 0 END) AS BIGINT) AS n_stretches
FROM w GROUP BY user_id"""
)
def in_flight_time(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds in which at least one of a user's events was in flight, an event taking as many seconds as its value."""
    rows = _events(spark, folder).where("value >= 0").select("user_id", _seconds().alias("a"), (_seconds() + F.floor("value")).alias("b"))
    return eventlog.covered(rows, ["user_id"], "a", "b")


@query(
    """WITH v AS (SELECT event_id // 20 AS task, event_type, count(*) AS votes, round(sum(value), 6) AS weight, min(event_id) AS first FROM events GROUP BY ALL),
r AS (SELECT *, sum(votes) OVER (PARTITION BY task) AS n_votes, row_number() OVER (PARTITION BY task ORDER BY votes DESC, weight DESC, first) AS place FROM v)
SELECT task, event_type AS winner, votes, CAST(n_votes AS BIGINT) AS n_votes, round(votes / n_votes, 6) AS agreement, round(weight / votes * (votes / n_votes), 6) AS confidence FROM r WHERE place = 1"""
)
def plurality_vote(spark: SparkSession, folder: str) -> DataFrame:
    """The event type that most of twenty consecutive events vote for."""
    votes = table(spark, folder, "events").withColumn("task", F.expr("event_id div 20"))
    return eventlog.plurality(votes, "task", "event_type", "value", "event_id")


@query(
    """SELECT user_id, min(event_id) AS first_event, max(event_id) AS last_event, CAST(max(epoch_us(ts)) - min(epoch_us(ts)) AS BIGINT) AS span_us,
       count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id"""
)
def trace_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's log folded into one row."""
    kind = lambda name: F.count_if(F.col("event_type") == name)
    return _events(spark, folder).groupBy("user_id").agg(
        F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))).alias("span_us"),
        kind("click").alias("n_click"), kind("error").alias("n_error"), F.max_by("event_type", "event_id").alias("last_type"),
    )


@query("""SELECT event_type, user_id, min(event_id) AS first_step, max(event_id) AS last_step, count(*) AS blocked_count FROM events GROUP BY event_type, user_id""")
def route_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """First and last step and number of the events of each route."""
    return table(spark, folder, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("first_step"), F.max("event_id").alias("last_step"), F.count("*").alias("blocked_count"))


@query("""SELECT event_type, user_id % 10 AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type, bucket)""")
def usage_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Usage by type and bucket, by type, and in all."""
    rows = table(spark, folder, "events").withColumn("bucket", F.col("user_id") % 10)
    return rows.rollup("event_type", "bucket").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL""")
def property_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type and by a property of their payload."""
    return table(spark, folder, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT DISTINCT user_id, event_type FROM events), e AS (SELECT user_id FROM s WHERE event_type = 'error'), c AS (SELECT user_id FROM s WHERE event_type = 'click')
SELECT 'union' AS kind, count(*) AS n FROM (SELECT * FROM e UNION SELECT * FROM c) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM e INTERSECT SELECT * FROM c)
UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM c) UNION ALL SELECT 'bag', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'error' UNION ALL SELECT user_id FROM events WHERE event_type = 'click')"""
)
def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the union, intersection, difference and bag union of the users of two event types."""
    events = table(spark, folder, "events").select("user_id", "event_type")
    failed, clicked = (events.where(F.col("event_type") == t).select("user_id") for t in ("error", "click"))
    parts = {"union": failed.union(clicked).distinct(), "intersect": failed.intersect(clicked), "except": failed.subtract(clicked), "bag": failed.unionByName(clicked)}
    sizes = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in parts.items()]
    out = sizes[0]
    for other in sizes[1:]:
        out = out.unionByName(other)
    return out


@query(
    """WITH c AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
SELECT u.user_id, c.user_id IS NOT NULL AS cached, u.n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) u LEFT JOIN c ON u.user_id = c.user_id"""
)
def cached_and_novel(spark: SparkSession, folder: str) -> DataFrame:
    """Users split into those already seen in a set and new ones, by a semi and an anti join."""
    events = table(spark, folder, "events")
    users = events.groupBy("user_id").agg(F.count("*").alias("n"))
    seen = events.where("event_type = 'error'").select("user_id").distinct()
    known = users.join(seen, "user_id", "left_semi").withColumn("cached", F.lit(True))
    return known.unionByName(users.join(seen, "user_id", "left_anti").withColumn("cached", F.lit(False)))


@query(
    """SELECT event_type, count(*) AS calls, count(*) FILTER (value > 50) AS failures, arg_max(event_id, event_id) FILTER (value > 50) AS last_failure, round(max(value) FILTER (value > 50), 4) AS worst FROM events GROUP BY event_type"""
)
def provider_health(spark: SparkSession, folder: str) -> DataFrame:
    """Counters and the last failure of each provider."""
    bad = F.col("value") > 50
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if(bad).alias("failures"), F.max(F.when(bad, F.col("event_id"))).alias("last_failure"), F.round(F.max(F.when(bad, F.col("value"))), 4).alias("worst"))

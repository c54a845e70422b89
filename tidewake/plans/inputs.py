"""Driver tables in the roles that the engine's operators expect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KINDS = ("signup", "view", "click", "purchase", "error")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The event log: ingest days after the event, site and service from the user, money in cents.
EVENTS_SQL = """ev AS (
    SELECT *, site || '-' || CAST(user_id % 6 AS VARCHAR) AS service FROM (
        SELECT event_id, ts, user_id, event_type, value, props, ts + to_days(CAST(event_id % 13 AS INTEGER)) AS ingest_ts,
            CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS site, CAST(round(value * 100) AS BIGINT) AS cents
        FROM events)
)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    site = F.when(F.col("user_id") % 2 == 0, "A").otherwise("B")
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value", "props",
        (F.col("ts") + F.make_dt_interval((F.col("event_id") % 13).cast("int"))).alias("ingest_ts"),
        site.alias("site"),
        F.concat(site, F.lit("-"), (F.col("user_id") % 6).cast("string")).alias("service"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )


#: Documents as scored cases: a score from the length, two binary raters.
SCORED_SQL = """scored AS (
    SELECT d.doc_id, l.quality AS y, l.toxic AS y2, d.lang AS service, d.source,
        least(1.0::DOUBLE, d.n_chars / 5000.0::DOUBLE) AS score
    FROM labels l JOIN documents d USING (doc_id)
)"""


def scored_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return l.join(d, "doc_id").select(
        "doc_id", F.col("quality").alias("y"), F.col("toxic").alias("y2"), F.col("lang").alias("service"), "source", F.least(F.lit(1.0), F.col("n_chars") / F.lit(5000.0)).alias("score")
    )


#: Orders as cases of a before/after study: nation parity is the arm, the order date the switch.
STUDY_SQL = """study AS (
    SELECT o_orderkey, c_custkey, n_name AS service, CASE WHEN n_nationkey % 2 = 0 THEN 'A' ELSE 'B' END AS site,
        o_orderdate >= TIMESTAMP '1998-05-01' AS after, o_orderdate, c_mktsegment AS segment, o_orderpriority AS priority, o_orderstatus AS status,
        CAST(o_totalprice > 250000 AS INTEGER) AS y, o_totalprice, c_acctbal, c_nationkey
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    # nation has a row for each country, whatever the scale
    rows = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        "o_orderkey", "c_custkey", F.col("n_name").alias("service"), F.when(F.col("n_nationkey") % 2 == 0, "A").otherwise("B").alias("site"),
        (F.col("o_orderdate") >= F.lit("1998-05-01").cast("timestamp_ntz")).alias("after"), "o_orderdate", F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") > 250000).cast("int").alias("y"), "o_totalprice", "c_acctbal", "c_nationkey",
    )


#: Each view with the hours to the same user's next purchase; 90 hours of follow-up at most.
ENDPOINT_SQL = """views AS (
    SELECT * FROM (
        SELECT event_id, user_id, site, service, event_type, ts,
            min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ts,
            max(ts) OVER () AS end_ts
        FROM ev) WHERE event_type = 'view'
), endpoints AS (
    SELECT event_id, user_id, site, service, ts, epoch_us(end_ts) - epoch_us(ts) AS follow_us,
        CASE WHEN next_ts IS NOT NULL THEN epoch_us(next_ts) - epoch_us(ts) END AS wait_us FROM views
)"""


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewake.functions.identifiers import micros

    log = event_log(spark, sf_dir)
    later = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    rows = log.withColumn("next_ts", F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(later)).filter("event_type = 'view'")
    end = log.agg(F.max("ts").alias("end_ts"))  # one row
    rows = rows.crossJoin(F.broadcast(end))
    return rows.select(
        "event_id", "user_id", "site", "service", "ts", (micros("end_ts") - micros("ts")).alias("follow_us"), F.when(F.col("next_ts").isNotNull(), micros("next_ts") - micros("ts")).alias("wait_us")
    )

"""Queries along time: the latest earlier row, open intervals, sessions and what follows within an hour."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewake.functions.identifiers import micros
from tidewake.operators import temporal
from tidewake.operators.graph import shared_dir
from tidewake.operators.sketches import Sketches, trailing
from tidewake.plans.inputs import EVENTS_SQL, event_log, query, table
from tidewake.sources import incremental


@query("asof_last_order", """WITH marks AS (SELECT o_custkey AS user_id, o_orderdate AS at, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2)
SELECT e.event_id, m.o_orderkey, m.o_totalprice FROM events e ASOF LEFT JOIN marks m ON e.user_id = m.user_id AND e.ts >= m.at""")
def asof_last_order(spark, sf_dir):
    """Each event with the latest order of its user before it."""
    events, orders = table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), table(spark, sf_dir, "orders")
    marks = orders.select(F.col("o_custkey").alias("user_id"), "o_orderdate", "o_orderkey", "o_totalprice")
    return temporal.asof_join(events, marks, ["user_id"], "ts", "o_orderdate", ["o_orderkey", "o_totalprice"], "o_orderkey").drop("user_id", "ts")


@query("asof_order_of_nation", """WITH ships AS (SELECT l_orderkey, l_linenumber, l_shipdate, s_nationkey AS nation FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
marks AS (SELECT c_nationkey AS nation, o_orderdate AS at, max(o_orderkey) AS o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT s.l_orderkey, s.l_linenumber, s.nation, CASE WHEN epoch_us(s.l_shipdate) - epoch_us(m.at) <= 86400000000 THEN m.o_orderkey END AS o_orderkey FROM ships s ASOF LEFT JOIN marks m ON s.nation = m.nation AND s.l_shipdate >= m.at""")
def asof_order_of_nation(spark, sf_dir):
    """Each shipment with the latest order of its supplier's nation, a day old at most: 25 keys for all rows."""
    supplier, customer = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    ships = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "l_shipdate", F.col("s_nationkey").alias("nation"))
    marks = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), "o_orderdate", "o_orderkey")
    return temporal.asof_join(ships, marks, ["nation"], "l_shipdate", "o_orderdate", ["o_orderkey"], "o_orderkey", within=86_400).drop("l_shipdate")


@query("orders_still_open", """WITH spans AS (SELECT o_custkey, o_orderkey AS open_key, o_orderdate AS opened, max(l_shipdate) AS closed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o.o_orderkey, count(*) AS n_open, min(s.open_key) AS first_open FROM orders o JOIN spans s ON s.o_custkey = o.o_custkey AND o.o_orderdate >= s.opened AND o.o_orderdate < s.closed GROUP BY 1""")
def orders_still_open(spark, sf_dir):
    """At each order, the orders of the same customer that are open: placed, and not wholly shipped."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    closed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("closed"))
    spans = orders.join(closed, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.col("o_orderkey").alias("open_key"), F.col("o_orderdate").alias("opened"), "closed")
    found = temporal.interval_join(orders, spans, ["o_custkey"], "o_orderdate", "opened", "closed")
    return found.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_open"), F.min("open_key").alias("first_open"))


@query("user_sessions", f"""WITH {EVENTS_SQL}, marked AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 90 MINUTE THEN 0 ELSE 1 END AS begins FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
islands AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 5400000000 AS end_us, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM islands GROUP BY user_id, island""")
def user_sessions(spark, sf_dir):
    found = temporal.sessions(event_log(spark, sf_dir), ["user_id"], "ts", "90 minutes", [F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")])
    return found.select("user_id", micros("session_start").alias("start_us"), micros("session_end").alias("end_us"), "n", "cents")


@query("purchase_within_hours", f"""WITH {EVENTS_SQL} SELECT v.event_id, p.event_id AS purchase_id, p.cents FROM ev v LEFT JOIN (SELECT * FROM ev WHERE event_type = 'purchase') p ON p.user_id = v.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 3 HOUR WHERE v.event_type = 'view'""")
def purchase_within_hours(spark, sf_dir):
    """Views with the purchases of the same user up to three hours later, or alone."""
    log = event_log(spark, sf_dir)
    views = log.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    purchases = log.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("bought_at"), "cents")
    return temporal.followed_within(views, purchases, "user_id", "ts", "bought_at", "3 hours", how="left_outer").select("event_id", "purchase_id", "cents")


_SKETCHES = Sketches(distinct=("user_id",), quantiles=("value",))
_SKETCH_SCHEMA = "week date, service string, n bigint, user_id_distinct binary, value_quantiles binary"


@query("trailing_sketches", f"""WITH {EVENTS_SQL}, weekly AS (SELECT CAST(date_trunc('week', ingest_ts) AS DATE) AS week, service, user_id, value FROM ev), spans AS (SELECT DISTINCT week FROM weekly)
SELECT CAST(s.week AS VARCHAR) AS week, service, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_within, true AS median_within, true AS p90_within
FROM spans s JOIN weekly w ON w.week BETWEEN s.week - 21 AND s.week GROUP BY 1, 2""")
def trailing_sketches(spark, sf_dir):
    """Users and quantiles of four weeks of arrivals, merged from the sketches kept of each week, and whether they are as near to the exact figures as stated."""
    week = F.date_trunc("week", "ingest_ts").cast("date")
    log = event_log(spark, sf_dir).select(week.alias("week"), "service", "user_id", "value")
    at = f"{shared_dir(spark)}/sketches-{uuid.uuid4().hex}"
    build = lambda weeks: _SKETCHES.build(log.filter(F.col("week").cast("string").isin(weeks)), ["week", "service"]).withColumn("partition", F.col("week").cast("string"))
    incremental.refresh_together(spark, at, incremental.row_digests(log, "week"), incremental.version_of(_SKETCHES), build)
    kept = incremental.read_together(spark, at, _SKETCH_SCHEMA).drop("partition")
    ends = kept.select("week").distinct()
    merged = _SKETCHES.merge(trailing(kept, "week", 4).join(ends, "week", "left_semi"), ["week", "service"])
    found = _SKETCHES.estimates(merged, ["week", "service"], {"median": 0.5, "p90": 0.9})
    # one row for each week and service, whatever the rows
    rows = trailing(log, "week", 4).join(F.broadcast(found.withColumnRenamed("n", "n_kept")), ["week", "service"])
    counts = [F.count_if(F.col("value") < F.col(f"value_{q}")).alias(f"under_{q}") for q in ("median", "p90")] + [F.count_if(F.col("value") <= F.col(f"value_{q}")).alias(f"upto_{q}") for q in ("median", "p90")]
    exact = rows.groupBy("week", "service", "n_kept", "user_id_distinct").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count("value").alias("numbers"), *counts)
    error = F.lit(_SKETCHES.rank_error) * F.col("numbers")
    within = lambda q, f: (F.col(f"under_{q}") <= f * F.col("numbers") + error) & (F.col(f"upto_{q}") >= f * F.col("numbers") - error)
    return exact.select(
        F.col("week").cast("string").alias("week"), "service", "n", "users", ((F.col("n") == F.col("n_kept")) & (F.abs(F.col("users") - F.col("user_id_distinct")) <= F.ceil(_SKETCHES.distinct_error * F.col("users")))).alias("users_within"),
        within("median", 0.5).alias("median_within"), within("p90", 0.9).alias("p90_within"),
    )

"""Queries over the event log and its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import identifiers as ids
from tidewake.functions.timezones import resolve_offset, to_utc, valid_offsets
from tidewake.operators import contracts, events
from tidewake.plans.inputs import EVENTS_SQL, KINDS, event_log, query, table

asc, desc = (lambda c: F.col(c).asc_nulls_last()), (lambda c: F.col(c).desc_nulls_last())


def _retry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem rows of one order line are retries of each other; ship mode of the part's parity stands for the source."""
    li = table(spark, sf_dir, "lineitem")
    return li.withColumn("source", (F.col("l_suppkey") % 3).cast("int")).withColumn("price_cents", ids.cents("l_extendedprice"))


@query("canonical_dedup", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, price_cents, copies, first_seen_us, last_seen_us, n_sources FROM (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents,
        row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS nth,
        count(*) OVER k AS copies, epoch_us(min(l_shipdate) OVER k) AS first_seen_us, epoch_us(max(l_shipdate) OVER k) AS last_seen_us,
        count(DISTINCT l_suppkey % 3) OVER k AS n_sources
    FROM lineitem WINDOW k AS (PARTITION BY l_orderkey, l_linenumber)) WHERE nth = 1""")
def canonical_dedup(spark, sf_dir):
    order = [asc(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")]
    out = events.survivors(_retry_rows(spark, sf_dir), ["l_orderkey", "l_linenumber"], order, "l_shipdate", "source")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price_cents", "copies", ids.micros("first_seen").alias("first_seen_us"), ids.micros("last_seen").alias("last_seen_us"), F.col("n_sources").cast("long").alias("n_sources"))


@query("retry_stats", """
SELECT l_orderkey, l_linenumber, count(*) AS copies, epoch_us(min(l_shipdate)) AS first_seen_us, epoch_us(max(l_shipdate)) AS last_seen_us, count(DISTINCT l_suppkey % 3) AS n_sources
FROM lineitem GROUP BY 1, 2""")
def retry_stats(spark, sf_dir):
    out = events.retry_statistics(_retry_rows(spark, sf_dir), ["l_orderkey", "l_linenumber"], "l_shipdate", "source")
    return out.select("l_orderkey", "l_linenumber", "copies", ids.micros("first_seen").alias("first_seen_us"), ids.micros("last_seen").alias("last_seen_us"), "n_sources")


@query("case_id_normalize", """
WITH raw AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' ' || c_custkey || ' ' WHEN 1 THEN 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') WHEN 2 THEN 'X' || c_custkey ELSE CAST(c_custkey * 10000000 AS VARCHAR) END AS raw_id FROM customer)
SELECT c_custkey, CASE WHEN regexp_full_match(upper(trim(raw_id)), 'C[0-9]{9}') THEN upper(trim(raw_id))
    WHEN regexp_full_match(upper(trim(raw_id)), '[0-9]{1,9}') THEN 'C' || lpad(upper(trim(raw_id)), 9, '0') END AS case_id, length(raw_id) AS raw_length FROM raw""")
def case_id_normalize(spark, sf_dir):
    k = F.col("c_custkey")
    text = k.cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" "), text, F.lit(" "))).when(k % 4 == 1, F.concat(F.lit("c"), F.lpad(text, 9, "0"))).when(k % 4 == 2, F.concat(F.lit("X"), text)).otherwise((k * 10000000).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", ids.canonical_case_id(raw).alias("case_id"), F.length(raw).cast("long").alias("raw_length"))


def _rejections() -> list:
    return [
        ("kind_unknown", ~F.col("event_type").isin("view", "click", "purchase", "signup")),
        *events.ingest_lag_rules(F.col("ts"), F.col("ingest_ts"), 10),
        *events.money_rules(F.col("value"), 0, 90),
    ]


@query("event_normalize_classify", f"""
WITH {EVENTS_SQL}
SELECT event_id, upper(trim(event_type)) AS kind, coalesce(nullif(event_type, 'view'), 'seen') AS kind_or_seen, substr(event_type, 1, 3) AS prefix, site, service,
    CASE WHEN CAST(ts AS DATE) < DATE '2024-01-08' THEN 'before' WHEN CAST(ts AS DATE) < DATE '2024-01-22' THEN 'within' ELSE 'after' END AS study_window,
    CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup') THEN 'kind_unknown' WHEN ingest_ts < ts THEN 'ingest_before_event' WHEN ingest_ts > ts + INTERVAL 10 DAY THEN 'ingest_too_late'
        WHEN value NOT BETWEEN 0 AND 90 THEN 'amount_out_of_range' WHEN abs(value * 100 - round(value * 100)) > 1e-6 THEN 'amount_not_in_cents' END AS rejection_reason,
    strftime(ts, '%Y-%m') AS month, CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week,
    date_diff('day', CAST(ts AS DATE), CAST(ingest_ts AS DATE)) AS lag_days, starts_with(service, site || '-') AS service_of_site, CAST(try_cast(json_extract_string(props, '$.k') AS INTEGER) AS BIGINT) AS k
FROM ev""")
def event_normalize_classify(spark, sf_dir):
    e = event_log(spark, sf_dir)
    return e.select(
        "event_id", ids.tidy("event_type").alias("kind"), F.coalesce(F.nullif(F.col("event_type"), F.lit("view")), F.lit("seen")).alias("kind_or_seen"), F.substring("event_type", 1, 3).alias("prefix"), "site", "service",
        events.window_label(F.col("ts"), "2024-01-08", "2024-01-22").alias("study_window"),
        events.first_reason(*_rejections()).alias("rejection_reason"),
        F.date_format("ts", "yyyy-MM").alias("month"), F.date_trunc("hour", "ts").cast("timestamp_ntz").cast("string").alias("hour"), ids.week_start("ts").cast("string").alias("week"),
        F.datediff(F.to_date("ingest_ts"), F.to_date("ts")).cast("long").alias("lag_days"), F.col("service").startswith(F.concat(F.col("site"), F.lit("-"))).alias("service_of_site"),
        F.get_json_object("props", "$.k").try_cast("int").cast("long").alias("k"),
    )


@query("rejection_reasons", """
SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n_rows, count(*) FILTER (l_returnflag = 'R') AS n_returned, CAST(sum(cents) AS BIGINT) AS cents FROM (
    SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CASE WHEN p_partkey IS NULL THEN 'part_unknown' WHEN p_size NOT BETWEEN 3 AND 48 THEN 'size_out_of_range' WHEN l_returnflag = 'R' AND l_discount > 0.05 THEN 'returned_discount'
        WHEN l_quantity > 45 THEN 'quantity_too_large' WHEN l_linestatus <> 'O' AND l_tax >= 0.08 THEN 'tax_too_high' END AS reason
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey) GROUP BY 1""")
def rejection_reasons(spark, sf_dir):
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_size")
    rows = li.join(p, li.l_partkey == p.p_partkey, "left")
    reason = events.first_reason(
        ("part_unknown", F.col("p_partkey").isNull()), ("size_out_of_range", ~F.col("p_size").between(3, 48)), ("returned_discount", (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05)),
        ("quantity_too_large", F.col("l_quantity") > 45), ("tax_too_high", (F.col("l_linestatus") != "O") & (F.col("l_tax") >= 0.08)),
    )
    rows = rows.withColumn("reason", F.coalesce(reason, F.lit("accepted")))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.sum(ids.cents("l_extendedprice")).alias("cents"))


@query("schema_evolution_coalesce", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN upper(o_orderpriority) WHEN o_orderkey % 7 = 0 THEN 'UNKNOWN' ELSE upper(trim(o_orderpriority)) END AS service_code,
    CASE WHEN o_orderkey % 3 = 0 THEN 'legacy' WHEN o_orderkey % 7 = 0 THEN 'backfilled' ELSE 'current' END AS origin FROM orders""")
def schema_evolution_coalesce(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.col("o_orderpriority").alias("svc_code"))
    new = o.filter("o_orderkey % 3 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "UNKNOWN").otherwise(F.col("o_orderpriority")).alias("service_code"))
    value, origin = ids.coalesce_generations("service_code", "svc_code")
    return old.unionByName(new, allowMissingColumns=True).select("o_orderkey", value.alias("service_code"), origin.alias("origin"))


@query("semantic_key_hash", """
SELECT o_orderkey, sha256(concat_ws('|', CAST(o_custkey AS VARCHAR), coalesce(nullif(o_orderstatus, 'P'), '<NULL>'), strftime(o_orderdate, '%Y-%m-%d'), CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR))) AS semantic_key FROM orders""")
def semantic_key_hash(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", ids.digest("o_custkey", F.nullif(F.col("o_orderstatus"), F.lit("P")), F.date_format("o_orderdate", "yyyy-MM-dd"), ids.cents("o_totalprice")).alias("semantic_key"))


@query("timezone_offsets", f"""WITH {EVENTS_SQL}, w AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2026-03-08 00:30:00' ELSE TIMESTAMP '2025-11-02 00:30:00' END + to_hours(CAST(event_id % 5 AS INTEGER)) AS wall, CASE WHEN event_id % 3 = 0 THEN -18000 END AS stated FROM ev),
o AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN CASE WHEN hour(wall) < 2 THEN [-21600] WHEN hour(wall) < 3 THEN [] ELSE [-18000] END ELSE CASE WHEN hour(wall) < 1 THEN [-18000] WHEN hour(wall) < 2 THEN [-21600, -18000] ELSE [-21600] END END AS offsets FROM w),
r AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'fixed_utc' WHEN len(offsets) = 0 THEN 'nonexistent_local_time' WHEN len(offsets) = 2 AND list_contains(offsets, stated) THEN 'stated_in_fold' WHEN stated IS NOT NULL AND NOT list_contains(offsets, stated) THEN 'stated_offset_invalid' WHEN len(offsets) = 2 THEN 'ambiguous_local_time' ELSE 'unique' END AS resolution,
    CASE WHEN event_id % 11 = 0 THEN 0 WHEN list_contains(offsets, stated) THEN stated WHEN len(offsets) = 1 THEN offsets[1] END AS off FROM o)
SELECT event_id, CAST(wall AS VARCHAR) AS wall, array_to_string(offsets, ',') AS offsets, CAST(off AS BIGINT) AS "offset", resolution, CAST(wall - to_seconds(off) AS VARCHAR) AS utc FROM r""")
def timezone_offsets(spark, sf_dir):
    e = event_log(spark, sf_dir)
    # wall clocks around both changes of the year, an hour apart in the night
    change = F.when(F.col("event_id") % 2 == 0, F.lit("2026-03-08 00:00:00")).otherwise(F.lit("2025-11-02 00:00:00")).cast("timestamp_ntz")
    wall = change + F.make_dt_interval(F.lit(0), (F.col("event_id") % 5).cast("int"), F.lit(30))
    e = e.withColumn("wall", wall).withColumn("offsets", valid_offsets(F.col("wall"), "America/Chicago"))
    stated = F.when(F.col("event_id") % 3 == 0, F.lit(-18000))
    offset, how = resolve_offset(F.col("offsets"), stated, F.col("event_id") % 11 == 0)
    e = e.withColumn("offset", offset).withColumn("resolution", how)
    return e.select("event_id", F.col("wall").cast("string").alias("wall"), F.array_join(F.col("offsets").cast("array<string>"), ",").alias("offsets"), F.col("offset").cast("long").alias("offset"), "resolution", to_utc(F.col("wall"), F.col("offset")).cast("string").alias("utc"))


_WINDOW_SQL = "CASE WHEN {c} IS NULL THEN 'unknown' WHEN CAST({c} AS DATE) < DATE '2024-01-08' THEN 'before' WHEN CAST({c} AS DATE) < DATE '2024-01-22' THEN 'within' ELSE 'after' END"


@query("study_clocks", f"""WITH {EVENTS_SQL}, c AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN 'fixed_utc' WHEN event_id % 7 = 0 AND event_id % 2 = 0 THEN 'stated_offset_invalid' ELSE 'unique' END AS resolution, CASE WHEN event_id % 10 = 0 THEN ts ELSE ts + INTERVAL 7 HOUR END AS utc FROM ev)
SELECT site, resolution, {_WINDOW_SQL.format(c='ts')} AS local_window, {_WINDOW_SQL.format(c='utc')} AS utc_window, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM c GROUP BY ALL""")
def study_clocks(spark, sf_dir):
    """Events by their place in the study window on both clocks: seven hours move some across its ends."""
    e = event_log(spark, sf_dir)
    stated = F.when(F.col("event_id") % 7 == 0, F.when(F.col("event_id") % 2 == 0, -18000).otherwise(-25200))
    rows = events.window_labels(e, "ts", "America/Phoenix", "2024-01-08", "2024-01-22", stated, F.col("event_id") % 10 == 0)
    return rows.groupBy("site", "resolution", "local_window", "utc_window").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("dimension_enrich_audit", """
SELECT audit, count(*) AS n_orders, count(DISTINCT c_nationkey) AS n_nations FROM (
    SELECT CASE WHEN key IS NULL THEN 'no_key' WHEN c_custkey IS NULL THEN 'unknown_key' WHEN c_nationkey <> o_custkey % 25 THEN 'mismatch' ELSE 'match' END AS audit, c_nationkey
    FROM (SELECT *, CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 50 = 1 THEN -o_custkey ELSE o_custkey END AS key FROM orders) LEFT JOIN customer ON key = c_custkey) GROUP BY 1""")
def dimension_enrich_audit(spark, sf_dir):
    k = F.col("o_orderkey") % 50
    o = table(spark, sf_dir, "orders").withColumn("key", F.when(k == 0, F.lit(None)).when(k == 1, -F.col("o_custkey")).otherwise(F.col("o_custkey")))
    out = events.enrich_with_audit(o, table(spark, sf_dir, "customer"), "key", "c_custkey", F.col("c_nationkey") != F.col("o_custkey") % 25)
    return out.groupBy("audit").agg(F.count(F.lit(1)).alias("n_orders"), F.count_distinct("c_nationkey").alias("n_nations"))


_RANK = "list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type)"


@query("case_workflow", f"""
WITH {EVENTS_SQL}, ordered AS (SELECT *, {_RANK} AS rank, lag(ts) OVER (PARTITION BY user_id ORDER BY ingest_ts, event_id) AS prior_ts FROM ev)
SELECT user_id, {', '.join(f"epoch_us(min(ts) FILTER (event_type = '{k}')) AS {k}_at" for k in KINDS)},
    first(site ORDER BY ts, event_id) AS first_site, first(service ORDER BY ts, event_id) AS first_service, first(event_type ORDER BY ts DESC, rank DESC, event_id DESC) AS last_state,
    epoch_us(max(ts)) AS last_event_at, count(*) AS n_events, CAST(sum(CASE WHEN ts < prior_ts THEN 1 ELSE 0 END) AS BIGINT) AS inversions, CAST(sum(coalesce(cents, 0)) AS BIGINT) AS total_cents,
    bool_or(event_type = 'error') AS had_error, count(DISTINCT service) AS n_services, date_diff('second', min(ts), max(ts)) AS span_seconds
FROM ordered GROUP BY user_id""")
def case_workflow(spark, sf_dir):
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type"))
    out = events.case_workflow(event_log(spark, sf_dir), "user_id", "ts", "event_type", KINDS, rank, "site", "service", "cents", "event_id", ["ingest_ts", "event_id"])
    at = [f"{k}_at" for k in KINDS] + ["last_event_at"]
    return out.withColumns({c: ids.micros(c) for c in at} | {"total_cents": F.col("total_cents").cast("long")})


@query("workflow_arrival_inversions", f"""
WITH {EVENTS_SQL}, ordered AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ingest_ts, event_id) AS prior_ts FROM ev)
SELECT site, service, count(*) AS n_events, count(*) FILTER (prior_ts IS NULL) AS n_first, count(*) FILTER (ts < prior_ts) AS inversions FROM ordered GROUP BY 1, 2""")
def workflow_arrival_inversions(spark, sf_dir):
    rows = events.arrival_order(event_log(spark, sf_dir), "user_id", "ts", ["ingest_ts", "event_id"])
    return rows.groupBy("site", "service").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("prior_event").isNull()).alias("n_first"), F.count_if(F.col("ts") < F.col("prior_event")).alias("inversions"))


@query("service_day", f"""
WITH {EVENTS_SQL}
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, site, service, count(*) AS n_events, count(DISTINCT user_id) AS n_cases, CAST(sum(coalesce(cents, 0)) AS BIGINT) AS total_cents, count(*) FILTER (cents IS NULL) AS n_without_money
FROM ev GROUP BY 1, 2, 3""")
def service_day(spark, sf_dir):
    return events.service_day(event_log(spark, sf_dir), "ts", "site", "service", "user_id", "cents").withColumns({"event_date": F.col("event_date").cast("string"), "total_cents": F.col("total_cents").cast("long")})


@query("partition_characterization", f"""
WITH {EVENTS_SQL}, lagged AS (SELECT *, strftime(ingest_ts, '%Y-%m') AS source_partition, date_diff('day', CAST(ts AS DATE), CAST(ingest_ts AS DATE)) AS lag FROM ev)
SELECT source_partition, count(*) AS n_rows, count(*) FILTER (ts IS NULL) AS n_without_time, count(*) FILTER (cents IS NULL) AS n_without_money, count(*) FILTER (event_type LIKE '%c%') AS n_kind_with_c,
    count(*) FILTER (event_type NOT LIKE 'p%') AS n_kind_not_p, count(*) FILTER (lag = 0) AS n_same_day, count(*) FILTER (lag >= 9) AS n_late,
    count(*) FILTER (strftime(ts, '%Y-%m') <> source_partition) AS n_other_month, count(*) FILTER (cents < 0) AS n_negative, epoch_us(min(ts)) AS first_event, epoch_us(max(ts)) AS last_event
FROM lagged GROUP BY 1""")
def partition_characterization(spark, sf_dir):
    out = events.partition_characterization(event_log(spark, sf_dir), F.date_format("ingest_ts", "yyyy-MM"), "ts", "ingest_ts", "event_type", "cents")
    return out.withColumns({c: ids.micros(c) for c in ("first_event", "last_event")})


@query("late_arrival_revisions", f"""
WITH {EVENTS_SQL}
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, CAST(CAST(ingest_ts AS DATE) AS VARCHAR) AS revision_date, strftime(ingest_ts, '%Y-%m') AS source_partition,
    date_diff('day', CAST(ts AS DATE), CAST(ingest_ts AS DATE)) AS lag_days, count(*) AS n_events, count(DISTINCT site) AS n_sites, bool_or(date_diff('day', CAST(ts AS DATE), CAST(ingest_ts AS DATE)) >= 9) AS is_late
FROM ev WHERE CAST(ts AS DATE) < DATE '2024-01-28' GROUP BY 1, 2, 3, 4""")
def late_arrival_revisions(spark, sf_dir):
    out = events.late_arrivals(event_log(spark, sf_dir), "ts", "ingest_ts", F.date_format("ingest_ts", "yyyy-MM"), "site", "2024-01-28")
    return out.withColumns({"event_date": F.col("event_date").cast("string"), "revision_date": F.col("revision_date").cast("string"), "lag_days": F.col("lag_days").cast("long")})


@query("quarantine", """
SELECT l_orderkey, l_linenumber, l_partkey, reason, CASE WHEN reason = 'quantity_too_large' THEN l_quantity END AS raw_quantity, CASE WHEN reason = 'returned_discount' THEN l_discount END AS raw_discount, count(*) AS n_rows FROM (
    SELECT *, CASE WHEN l_returnflag = 'R' AND l_discount > 0.05 THEN 'returned_discount' WHEN l_quantity > 45 THEN 'quantity_too_large' END AS reason FROM lineitem) WHERE reason IS NOT NULL GROUP BY ALL""")
def quarantine(spark, sf_dir):
    reason = events.first_reason(("returned_discount", (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05)), ("quantity_too_large", F.col("l_quantity") > 45))
    rows = table(spark, sf_dir, "lineitem").withColumn("reason", reason).filter("reason IS NOT NULL")
    keep = lambda r, c: F.when(F.col("reason") == r, F.col(c))
    return rows.groupBy("l_orderkey", "l_linenumber", "l_partkey", "reason", keep("quantity_too_large", "l_quantity").alias("raw_quantity"), keep("returned_discount", "l_discount").alias("raw_discount")).agg(F.count(F.lit(1)).alias("n_rows"))


_SNAPSHOT = ("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber")


@query("snapshot_case_summary", f"""
SELECT l_orderkey, count(*) AS n_rows, {', '.join(f'count(DISTINCT {c}) AS n_{c}' for c in _SNAPSHOT)},
    count(DISTINCT concat_ws('|', {', '.join(f"coalesce(CAST({c} AS VARCHAR), '<NULL>')" for c in _SNAPSHOT)})) AS n_distinct_rows,
    array_to_string(list_sort(list_distinct(list(CAST(CAST(l_shipdate AS DATE) AS VARCHAR)))), ',') AS dates
FROM lineitem GROUP BY 1""")
def snapshot_case_summary(spark, sf_dir):
    return events.snapshot_summary(table(spark, sf_dir, "lineitem"), "l_orderkey", _SNAPSHOT, "l_shipdate")


@query("reconciliation_full_outer", """
WITH w AS (SELECT o_orderkey AS key, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'), s AS (SELECT l_orderkey AS key, count(*) AS n_lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), m AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'O')
SELECT coalesce(w.key, s.key) AS key, o_orderstatus, n_lines, CASE WHEN w.key IS NOT NULL AND s.key IS NOT NULL THEN 'both' WHEN w.key IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS status, m.k IS NOT NULL AS known
FROM w FULL OUTER JOIN s ON w.key = s.key LEFT JOIN m ON coalesce(w.key, s.key) = m.k""")
def reconciliation_full_outer(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    left = o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    right = li.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("n_lines"))
    return events.reconcile(left, right, li.filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("key")), "key")


@query("unanimous_resolve", """
SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS l_returnflag, count(DISTINCT l_returnflag) AS n_l_returnflag,
    CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS l_linestatus, count(DISTINCT l_linestatus) AS n_l_linestatus,
    count(DISTINCT l_suppkey) FILTER (l_quantity > 25) AS n_large_suppliers FROM lineitem GROUP BY 1""")
def unanimous_resolve(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    large = F.when(F.col("l_quantity") > 25, F.col("l_suppkey"))
    return events.resolve_unanimous(li, "l_orderkey", ["l_returnflag", "l_linestatus"], counted={"n_large_suppliers": large})


@query("many_to_one_contract", """
SELECT 'order_customer.unique' AS contract, (SELECT count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)) AS observed, CAST(0 AS BIGINT) AS expected, (SELECT count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)) = 0 AS passed
UNION ALL SELECT 'order_customer.unmatched', n, 0, n = 0 FROM (SELECT count(*) AS n FROM orders ANTI JOIN customer ON o_custkey = c_custkey)
UNION ALL SELECT 'order_customer.rows', j.n, o.n, j.n = o.n FROM (SELECT count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey) j, (SELECT count(*) AS n FROM orders) o""")
def many_to_one_contract(spark, sf_dir):
    return contracts.many_to_one(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", "order_customer")


@query("grain_contract", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def grain_contract(spark, sf_dir):
    return contracts.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("one_to_one_contract", """
SELECT 'order_line.left' AS contract, count(*) AS observed, CAST(0 AS BIGINT) AS expected, count(*) = 0 AS passed FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'order_line.right', count(*), 0, count(*) = 0 FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)""")
def one_to_one_contract(spark, sf_dir):
    return contracts.one_to_one(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", "order_line")


@query("conservation_contract", f"""
WITH {EVENTS_SQL}, r AS (SELECT CASE WHEN event_type = 'error' THEN 'kind_error' WHEN ingest_ts > ts + INTERVAL 10 DAY THEN 'ingest_too_late' END AS reason FROM ev)
SELECT 'rows_conserved' AS contract, (SELECT count(*) FROM r) AS observed, (SELECT count(*) FROM events) AS expected, (SELECT count(*) FROM r) = (SELECT count(*) FROM events) AS passed
UNION ALL SELECT 'no_fatal_rejection', count(*) FILTER (reason NOT IN ('ingest_too_late')), 0, count(*) FILTER (reason NOT IN ('ingest_too_late')) = 0 FROM r""")
def conservation_contract(spark, sf_dir):
    e = event_log(spark, sf_dir)
    reason = events.first_reason(("kind_error", F.col("event_type") == "error"), *events.ingest_lag_rules(F.col("ts"), F.col("ingest_ts"), 10))
    return contracts.conservation(e.withColumn("reason", reason), "reason", table(spark, sf_dir, "events"), ["ingest_too_late"])


@query("key_coverage_anti", """
SELECT 'left_only' AS side, o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT DISTINCT 'right_only', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def key_coverage_anti(spark, sf_dir):
    return contracts.coverage(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


@query("union_universe", """
WITH u AS (SELECT o_custkey AS key FROM orders UNION SELECT c_custkey FROM customer), stacked AS (SELECT o_custkey AS key, 'order' AS clock FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer)
SELECT u.key, count(*) FILTER (clock = 'order') AS n_orders, count(*) FILTER (clock = 'customer') AS n_customers FROM u JOIN stacked USING (key) GROUP BY 1""")
def union_universe(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.lit("order").alias("clock"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("clock"))
    stacked = o.unionByName(c)
    return stacked.groupBy("key").agg(F.count_if(F.col("clock") == "order").alias("n_orders"), F.count_if(F.col("clock") == "customer").alias("n_customers"))


@query("code_in_columns", "SELECT o_orderkey, n_name IN (o_orderstatus, c_mktsegment, n_name) AS listed, o_orderpriority IN (c_mktsegment, o_orderstatus) AS crossed, c_mktsegment IN (nullif(c_mktsegment, 'BUILDING'), o_orderstatus) AS maybe FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def code_in_columns(spark, sf_dir):
    """A value among other columns of its row, with SQL's three values: null where no column is equal and one is null."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rows.select("o_orderkey", F.expr("n_name IN (o_orderstatus, c_mktsegment, n_name)").alias("listed"), F.expr("o_orderpriority IN (c_mktsegment, o_orderstatus)").alias("crossed"), F.expr("c_mktsegment IN (nullif(c_mktsegment, 'BUILDING'), o_orderstatus)").alias("maybe"))


@query("json_numbers", """WITH made AS (SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"list":[1.5,{"deep":' || event_id % 7 || '},"x",null,true],"more":{"a":{"b":' || event_id || '}}}' AS j FROM events)
SELECT event_id, replace(replace(t.fullkey, '$.', ''), '"', '') AS path, CAST(t.atom AS DOUBLE) AS number FROM made, json_tree(made.j) t WHERE t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE')""")
def json_numbers(spark, sf_dir):
    from tidewake.functions.documents import json_numbers as flatten

    e = table(spark, sf_dir, "events")
    made = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"list":[1.5,{"deep":'), (F.col("event_id") % 7).cast("string"), F.lit('},"x",null,true],"more":{"a":{"b":'), F.col("event_id").cast("string"), F.lit("}}}"))
    return flatten(e.select("event_id", made.alias("j")), ["event_id"], "j")


@query("snapshot_ranges", """SELECT 'customer.balance' AS contract, count(*) FILTER (NOT coalesce(c_acctbal BETWEEN -999.99 AND 9999.99, false)) AS observed, CAST(0 AS BIGINT) AS expected, count(*) FILTER (NOT coalesce(c_acctbal BETWEEN -999.99 AND 9999.99, false)) = 0 AS passed FROM customer
UNION ALL SELECT 'customer.segment', count(*) FILTER (NOT regexp_full_match(c_mktsegment, '[A-H][A-Z]+')), 0, count(*) FILTER (NOT regexp_full_match(c_mktsegment, '[A-H][A-Z]+')) = 0 FROM customer
UNION ALL SELECT 'customer.nation', count(*) FILTER (NOT c_nationkey BETWEEN 0 AND 24), 0, count(*) FILTER (NOT c_nationkey BETWEEN 0 AND 24) = 0 FROM customer""")
def snapshot_ranges(spark, sf_dir):
    rules = {"balance": F.col("c_acctbal").between(-999.99, 9999.99), "segment": ids.full_match("c_mktsegment", "[A-H][A-Z]+"), "nation": F.col("c_nationkey").between(0, 24)}
    return contracts.ranges(table(spark, sf_dir, "customer"), "customer", rules)


#: Events in the shape of a normalized log, each class of ids with a fault of its own.
_FAULTS_SQL = f"""f AS (SELECT event_id AS n, event_id % 31 AS k, ts, ingest_ts, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS s, cents FROM ev),
log AS (SELECT n, CASE WHEN k <> 1 THEN ts END AS event_ts_local, CASE WHEN k <> 2 THEN ingest_ts END AS ingest_ts_local, CASE WHEN k = 3 THEN '1999-01' ELSE strftime(ingest_ts, '%Y-%m') END AS source_partition, CASE k WHEN 4 THEN 'fax' WHEN 5 THEN 'hisB' ELSE 'hisA' END AS source_system,
    CASE WHEN k IN (4, 5) THEN -6 WHEN n % 2 = 0 THEN -5 END AS tz, CASE k WHEN 6 THEN NULL WHEN 8 THEN 0 ELSE 1 END AS ec, CASE k WHEN 7 THEN NULL WHEN 9 THEN 0 ELSE 1 END AS ic, CASE WHEN k <> 10 THEN -6 END AS eo, CASE WHEN k <> 11 THEN -6 END AS io,
    CASE WHEN k = 12 THEN 'x' ELSE printf('%016x', n) END AS event_id, CASE WHEN k <> 13 THEN 'C' || n END AS case_id, CASE WHEN k = 14 THEN 'other' WHEN n % 3 = 0 THEN 'case_closed' ELSE 'seen' END AS event_type, CASE WHEN k = 15 THEN 'Z' ELSE s END AS site,
    CASE WHEN k = 16 THEN 'M1' ELSE 'MD0001' END AS clinician_id, CASE WHEN k <> 17 THEN 'MD0001' END AS dim_id, CASE WHEN k = 18 THEN NULL ELSE s || '-W1' END AS ward_id, CASE WHEN k = 19 THEN 'X' ELSE s END AS dim_site, s || '-W1' AS dim_ward,
    CASE k WHEN 20 THEN '?' WHEN 21 THEN CASE s WHEN 'A' THEN 'B-ENT' ELSE 'A-ENT' END ELSE s || '-ENT' END AS service_code, CASE WHEN k = 22 THEN ' ent2 ' ELSE 'UNKNOWN' END AS raw_new, s || '-ENT' AS raw_old,
    CASE WHEN k = 23 THEN NULL WHEN k = 24 THEN 1.0 WHEN n % 3 = 0 THEN CASE k WHEN 25 THEN 1e6 WHEN 26 THEN 1.005 ELSE cents / 100.0::DOUBLE END END AS cost,
    ts AS event_utc, CASE WHEN k = 27 THEN ts - INTERVAL 1 HOUR ELSE ingest_ts END AS ingest_utc FROM f)"""


@query("rejection_chain", f"""WITH {EVENTS_SQL}, {_FAULTS_SQL} SELECT n, CASE WHEN event_ts_local IS NULL THEN 'invalid_event_timestamp' WHEN ingest_ts_local IS NULL THEN 'invalid_ingest_timestamp' WHEN strftime(ingest_ts_local, '%Y-%m') <> source_partition THEN 'ingest_partition_mismatch'
    WHEN source_system = 'fax' THEN 'unknown_source_system' WHEN source_system = 'hisB' AND tz <> 0 OR source_system = 'hisA' AND tz NOT IN (-5, -6) THEN 'invalid_supplied_offset' WHEN ec IS NULL THEN 'missing_event_timezone_rule' WHEN ic IS NULL THEN 'missing_ingest_timezone_rule'
    WHEN ec = 0 THEN 'event_nonexistent_local_time' WHEN ic = 0 THEN 'ingest_nonexistent_local_time' WHEN eo IS NULL THEN 'unresolved_event_timezone' WHEN io IS NULL THEN 'unresolved_ingest_timezone' WHEN length(event_id) <> 16 THEN 'malformed_event_id' WHEN case_id IS NULL THEN 'malformed_case_id'
    WHEN event_type = 'other' THEN 'unknown_event_type' WHEN site = 'Z' THEN 'invalid_site' WHEN length(clinician_id) <> 6 THEN 'malformed_clinician_id' WHEN dim_id IS NULL THEN 'unmatched_clinician_id' WHEN ward_id IS NULL THEN 'malformed_ward_id' WHEN dim_site <> site THEN 'clinician_dimension_mismatch'
    WHEN service_code = '?' THEN 'invalid_service_code' WHEN service_code[1] <> site THEN 'service_site_mismatch' WHEN raw_new <> 'UNKNOWN' THEN 'conflicting_service_codes' WHEN event_type = 'case_closed' AND cost IS NULL THEN 'missing_close_cost' WHEN event_type <> 'case_closed' AND cost IS NOT NULL THEN 'unexpected_event_cost'
    WHEN cost NOT BETWEEN 0 AND 100000 THEN 'cost_out_of_range' WHEN cost = 1.005 THEN 'cost_not_cent_exact' WHEN ingest_utc < event_utc THEN 'negative_ingest_lag' WHEN ingest_utc > event_utc + INTERVAL 10 DAY THEN 'ingest_lag_exceeds_contract' END AS reason FROM log""")
def rejection_chain(spark, sf_dir):
    from tidewake.operators.rejection import EventRules, rejection_reason

    n = F.col("event_id")
    k, s = n % 31, F.col("site")
    is_ = lambda *v: k.isin(*v)
    unless = lambda v, c: F.when(~is_(v), c)
    closed = n % 3 == 0
    cost = F.when(is_(23), None).when(is_(24), 1.0).when(closed, F.when(is_(25), 1e6).when(is_(26), 1.005).otherwise(F.col("cents") / 100.0))
    log = event_log(spark, sf_dir).select(
        n.alias("n"), unless(1, F.col("ts")).alias("event_ts_local"), unless(2, F.col("ingest_ts")).alias("ingest_ts_local"), F.when(is_(3), "1999-01").otherwise(F.date_format("ingest_ts", "yyyy-MM")).alias("source_partition"),
        F.when(is_(4), "fax").when(is_(5), "hisB").otherwise("hisA").alias("source_system"), F.when(is_(4, 5), -6.0).when(n % 2 == 0, -5.0).alias("tz_offset_hours"),
        unless(6, F.when(is_(8), 0).otherwise(1)).alias("event_offset_count"), unless(7, F.when(is_(9), 0).otherwise(1)).alias("ingest_offset_count"), unless(10, F.lit(-6)).alias("event_offset_hours"), unless(11, F.lit(-6)).alias("ingest_offset_hours"),
        F.when(is_(12), "x").otherwise(F.lower(F.lpad(F.hex(n), 16, "0"))).alias("event_id"), unless(13, F.concat(F.lit("C"), n.cast("string"))).alias("case_id"), F.when(is_(14), "other").when(closed, "case_closed").otherwise("seen").alias("event_type"),
        F.when(is_(15), "Z").otherwise(s).alias("site"), F.when(is_(16), "M1").otherwise("MD0001").alias("clinician_id"), unless(17, F.lit("MD0001")).alias("dim_clinician_id"), unless(18, F.concat(s, F.lit("-W1"))).alias("ward_id"),
        F.when(is_(19), "X").otherwise(s).alias("dim_site"), F.concat(s, F.lit("-W1")).alias("dim_ward_id"), F.when(is_(20), "?").when(is_(21), F.when(s == "A", "B-ENT").otherwise("A-ENT")).otherwise(F.concat(s, F.lit("-ENT"))).alias("service_code"),
        F.when(is_(22), " ent2 ").otherwise("UNKNOWN").alias("raw_service_code"), F.concat(s, F.lit("-ENT")).alias("raw_svc_code"), cost.alias("cost_cad"),
        F.col("ts").alias("event_ts_utc"), F.when(is_(27), F.col("ts") - F.expr("interval 1 hour")).otherwise(F.col("ingest_ts")).alias("ingest_ts_utc"),
    )
    rules = EventRules({"hisA": (-5.0, -6.0), "hisB": (0.0,), "device": ()}, ("seen", "case_closed"), ("A", "B"), "case_closed")
    return log.select("n", rejection_reason(rules).alias("reason"))


@query("canonical_id_join", """WITH raw AS (SELECT c_custkey, c_nationkey, CASE c_custkey % 4 WHEN 0 THEN ' ' || c_custkey || ' ' WHEN 1 THEN 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') WHEN 2 THEN 'X' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS raw_id FROM customer),
named AS (SELECT c_nationkey, CASE WHEN regexp_full_match(upper(trim(raw_id)), 'C[0-9]{9}') THEN upper(trim(raw_id)) WHEN regexp_full_match(upper(trim(raw_id)), '[0-9]{1,9}') THEN 'C' || lpad(upper(trim(raw_id)), 9, '0') END AS case_id FROM raw)
SELECT o_orderkey, c_nationkey, case_id IS NOT NULL AS matched FROM orders LEFT JOIN named ON 'C' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') = case_id""")
def canonical_id_join(spark, sf_dir):
    """Orders to customers whose ids are spelled in several ways, on the canonical spelling of both."""
    k = F.col("c_custkey")
    text = k.cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" "), text, F.lit(" "))).when(k % 4 == 1, F.concat(F.lit("c"), F.lpad(text, 9, "0"))).when(k % 4 == 2, F.concat(F.lit("X"), text)).otherwise(text)
    named = table(spark, sf_dir, "customer").select("c_nationkey", ids.canonical_case_id(raw).alias("case_id"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", ids.canonical_case_id(F.col("o_custkey").cast("string")).alias("id"))
    return o.join(named, F.col("id") == F.col("case_id"), "left").select("o_orderkey", "c_nationkey", F.col("case_id").isNotNull().alias("matched"))


@query("kind_grain", """SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1""")
def kind_grain(spark, sf_dir):
    """Cases with more than one event of a kind: what a workflow's grain forbids."""
    return contracts.repeated_keys(table(spark, sf_dir, "events"), ["user_id", "event_type"])

"""The event log's tables: normalized and rejected events, survivors of retries, cases, days, late arrivals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.identifiers import boundary_seconds, full_match
from tidewake.functions.timezones import resolve_offset, to_utc, valid_offsets

#: Rows of a key whose values may meet in one set.
MOST_ROWS = 50_000


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds; a rule that is null doesn't."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return out


def exact_sum(amount: Column) -> Column:
    """A sum of whole numbers in 38 digits, nulls as 0: it doesn't overflow at any number of rows."""
    return F.sum(F.coalesce(amount, F.lit(0)).cast("decimal(28,0)")).cast("decimal(38,0)")


def ingest_lag_rules(event: Column, ingest: Column, most_days: int) -> list[tuple[str, Column]]:
    return [
        ("ingest_before_event", ingest < event),
        ("ingest_too_late", ingest > event + F.make_dt_interval(F.lit(most_days))),
    ]


def money_rules(amount: Column, low: float, high: float) -> list[tuple[str, Column]]:
    return [
        ("amount_out_of_range", ~amount.between(low, high)),
        ("amount_not_in_cents", F.abs(amount * 100 - F.round(amount * 100)) > 1e-6),
    ]


def pattern_rule(name: str, c: Column, pattern: str) -> tuple[str, Column]:
    return name, c.isNotNull() & ~full_match(c, pattern)


def window_label(when: Column, start: str, end: str) -> Column:
    """Where a wall clock lies relative to a study window of dates [start, end)."""
    day = F.to_date(when)
    return F.when(when.isNull(), "unknown").when(day < F.lit(start).cast("date"), "before").when(day < F.lit(end).cast("date"), "within").otherwise("after")


def window_labels(df: DataFrame, wall: str, zone: str | Column, start: str, end: str, stated: Column | None = None, fixed_utc: Column | None = None) -> DataFrame:
    """Adds ``offset``, ``resolution``, ``local_window`` and ``utc_window``: where a wall clock, and the UTC clock that it stands for, lie in a study window of dates.

    A wall clock without one certain offset has no UTC clock, and its UTC window is ``unknown``.
    """
    offsets = valid_offsets(F.col(wall), zone)
    rows = df.withColumn("_offsets", offsets)
    offset, how = resolve_offset(F.col("_offsets"), stated if stated is not None else F.lit(None).cast("int"), F.coalesce(fixed_utc, F.lit(False)) if fixed_utc is not None else F.lit(False))
    rows = rows.withColumns({"offset": offset, "resolution": how}).drop("_offsets")
    return rows.withColumns({"local_window": window_label(F.col(wall), start, end), "utc_window": window_label(to_utc(F.col(wall), F.col("offset")), start, end)})


def survivors(df: DataFrame, key: Sequence[str], order: Sequence[Column], seen: str, sources: str | None = None) -> DataFrame:
    """One row for each key, the first by ``order``, with its number of copies, first and last sighting and distinct sources.

    Counts, bounds and the row itself come from one window pass over the key, without a join.
    """
    by = Window.partitionBy(*key)
    out = df.withColumn("_nth", F.row_number().over(by.orderBy(*order)))
    out = out.withColumn("copies", F.count(F.lit(1)).over(by)).withColumn("first_seen", F.min(seen).over(by)).withColumn("last_seen", F.max(seen).over(by))
    if sources:
        out = out.withColumn("n_sources", F.size(F.collect_set(sources).over(by)))
    return out.filter("_nth = 1").drop("_nth")


def retry_statistics(df: DataFrame, key: Sequence[str], seen: str, sources: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.count_distinct(sources).alias("n_sources"))


def arrival_order(df: DataFrame, case: str, event: str, arrival: Sequence[str]) -> DataFrame:
    """Adds the event time of the row that arrived before."""
    by = Window.partitionBy(case).orderBy(*(F.col(c).asc_nulls_last() for c in arrival))
    return df.withColumn("prior_event", F.lag(event).over(by))


def case_workflow(df: DataFrame, case: str, event: str, kind: str, kinds: Sequence[str], rank: Column, site: str, service: str, money: str, tie: str, arrival: Sequence[str]) -> DataFrame:
    """One row for each case: first time of each kind of event, first site and service, last state, money, inversions.

    One aggregation over one window; all extremes are by (time, rank, id), so they are the same however rows arrive.
    """
    rows = arrival_order(df, case, event, arrival)
    earliest, latest = F.struct(F.col(event), F.col(tie)), F.struct(F.col(event), rank, F.col(tie))
    return rows.groupBy(case).agg(
        *(F.min(F.when(F.col(kind) == k, F.col(event))).alias(f"{k}_at") for k in kinds),
        F.min_by(site, earliest).alias("first_site"),
        F.min_by(service, earliest).alias("first_service"),
        F.max_by(kind, latest).alias("last_state"),
        F.max(event).alias("last_event_at"),
        F.count(F.lit(1)).alias("n_events"),
        F.sum(F.when(F.col(event) < F.col("prior_event"), 1).otherwise(0)).alias("inversions"),
        exact_sum(F.col(money)).alias("total_cents"),
        F.bool_or(F.col(kind) == "error").alias("had_error"),
        F.count_distinct(service).alias("n_services"),
        boundary_seconds(F.min(event), F.max(event)).alias("span_seconds"),
    )


def service_day(df: DataFrame, event: str, site: str, service: str, case: str, money: str) -> DataFrame:
    return df.groupBy(F.to_date(event).alias("event_date"), site, service).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_distinct(case).alias("n_cases"),
        exact_sum(F.col(money)).alias("total_cents"),
        F.count_if(F.col(money).isNull()).alias("n_without_money"),
    )


def partition_characterization(df: DataFrame, partition: Column, event: str, ingest: str, kind: str, money: str) -> DataFrame:
    """Counts and bounds of each source partition, in one pass."""
    lag = F.datediff(F.to_date(ingest), F.to_date(event))
    return df.groupBy(partition.alias("source_partition")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(event).isNull()).alias("n_without_time"),
        F.count_if(F.col(money).isNull()).alias("n_without_money"),
        F.count_if(F.col(kind).like("%c%")).alias("n_kind_with_c"),
        F.count_if(~F.col(kind).like("p%")).alias("n_kind_not_p"),
        F.count_if(lag == 0).alias("n_same_day"),
        F.count_if(lag >= 9).alias("n_late"),
        F.count_if(F.date_format(event, "yyyy-MM") != partition).alias("n_other_month"),
        F.count_if(F.col(money) < 0).alias("n_negative"),
        F.min(event).alias("first_event"),
        F.max(event).alias("last_event"),
    )


def late_arrivals(df: DataFrame, event: str, ingest: str, partition: Column, site: str, before: str, late_days: int = 9) -> DataFrame:
    """What each later day added to each event day; late rows are counted, never dropped."""
    day, revised = F.to_date(event), F.to_date(ingest)
    lag = F.datediff(revised, day)
    return (
        df.filter(day < F.lit(before).cast("date"))
        .groupBy(day.alias("event_date"), revised.alias("revision_date"), partition.alias("source_partition"), lag.alias("lag_days"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct(site).alias("n_sites"), F.bool_or(lag >= late_days).alias("is_late"))
    )


def snapshot_summary(df: DataFrame, case: str, columns: Sequence[str], when: str) -> DataFrame:
    """One row for each case of a snapshot whose keys repeat: how far the repeats agree.

    One shuffle, of the distinct rows of a case with their number; the distinct values of a column are then
    those of a few rows and are counted in one pass, without a copy of the rows for each column.
    """
    few = df.groupBy(case, *columns, F.to_date(when).cast("string").alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    return few.groupBy(case).agg(
        F.sum("_n").alias("n_rows"),
        *(F.size(F.collect_set(c)).cast("long").alias(f"n_{c}") for c in columns),
        F.size(F.collect_set(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("<NULL>")).alias(c) for c in columns)))).cast("long").alias("n_distinct_rows"),
        F.array_join(F.array_sort(F.collect_set("_day")), ",").alias("dates"),
    )


def reconcile(left: DataFrame, right: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Every key of either side once, where it occurs, and whether a third table knows it."""
    a, b = left.withColumn("in_left", F.lit(True)), right.withColumn("in_right", F.lit(True))
    both = a.join(b, a[key] == b[key], "full_outer").select(F.coalesce(a[key], b[key]).alias(key), *(F.col(c) for c in a.columns + b.columns if c != key))
    known = matches.select(F.col(key).alias("_known")).distinct()
    out = both.join(known, F.col(key) == F.col("_known"), "left")
    status = F.when(F.col("in_left") & F.col("in_right"), "both").when(F.col("in_left"), "left_only").otherwise("right_only")
    return out.withColumn("status", status).withColumn("known", F.col("_known").isNotNull()).drop("_known", "in_left", "in_right")


def resolve_unanimous(df: DataFrame, key: str, columns: Sequence[str], only: Column | None = None, counted: dict[str, Column] | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """A column's value where all rows of a key agree, else null, and how many values there are; ``counted`` adds the distinct values of expressions.

    Only the key and these values move, each row once, and the values of a key meet in one set. Keys of more than
    ``MOST_ROWS`` rows, which are counted first, go through partial distinct counts instead, so that no set and no task holds more.
    """
    pick = lambda c: F.when(only, F.col(c)) if only is not None else F.col(c)
    names = [*(f"_v{i}" for i in range(len(columns))), *(f"_c{i}" for i in range(len(counted or {})))]
    rows = df.select(F.col(key).alias("_key"), *(v.alias(n) for n, v in zip(names, [*map(pick, columns), *(counted or {}).values()], strict=True)))
    large = rows.groupBy(F.col("_key").alias("_large")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_rows).select("_large")
    same = F.col("_key").eqNullSafe(F.col("_large"))

    def in_set(n: str) -> Column:
        # 0.0 and -0.0 are one value
        return F.size(F.collect_set(F.col(n) + 0 if rows.schema[n].dataType.typeName() in ("float", "double") else F.col(n))).cast("long")

    def resolved(x: DataFrame, distinct: Callable[[str], Column]) -> DataFrame:
        aggs = []
        for c, n in zip(columns, names, strict=False):
            # extremes tell unanimity
            aggs += [F.when(F.min(n) == F.max(n), F.min(n)).alias(c), distinct(n).alias(f"n_{c}")]
        return x.groupBy(F.col("_key").alias(key)).agg(*aggs, *(distinct(n).alias(c) for c, n in zip(counted or {}, names[len(columns) :], strict=True)))

    few = rows.join(F.broadcast(large), same, "left_anti").repartition("_key")
    return resolved(few, in_set).unionByName(resolved(rows.join(F.broadcast(large), same, "left_semi"), F.count_distinct))


def enrich_with_audit(facts: DataFrame, dimension: DataFrame, key: str, dim_key: str, mismatch: Column) -> DataFrame:
    """Left join to a dimension, with a status for rows whose key is missing, unknown or contradicted by it."""
    out = facts.join(dimension, facts[key] == dimension[dim_key], "left")
    status = F.when(facts[key].isNull(), "no_key").when(dimension[dim_key].isNull(), "unknown_key").when(mismatch, "mismatch").otherwise("match")
    return out.withColumn("audit", status)


"""Why an event isn't admitted: the first rule of an ordered list that it breaks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewake.functions.identifiers import full_match
from tidewake.operators.events import first_reason


@dataclass(frozen=True)
class EventRules:
    """What a log admits: names of sources with the offsets (hours) that each may state, kinds, sites, patterns and bounds."""

    offsets: dict[str, tuple[float, ...]]
    kinds: Sequence[str]
    sites: Sequence[str]
    closing_kind: str
    event_id: str = "[0-9a-f]{16}"
    clinician_id: str = "MD[0-9]{4}"
    ward_id: str = "[AB]-W[1-4]"
    service: str = "[AB]-[A-Z]+"
    least_cost: float = 0.0
    most_cost: float = 100_000.0
    most_lag_days: int = 10


def _misses(c: str, pattern: str) -> Column:
    return F.coalesce(~full_match(c, pattern), F.lit(True))


def _code(c: str) -> Column:
    """A service code that says something: trimmed, upper case, null where it is the unknown one."""
    return F.nullif(F.upper(F.trim(c)), F.lit("UNKNOWN"))


def rejection_rules(r: EventRules) -> list[tuple[str, Column]]:
    """All rules in order, over the columns of a normalized event joined with its clinician (``dim_*``) and both clocks' offset counts.

    Names of reasons are fixed values.
    """
    col = F.col
    stated = F.lit(False)
    for source, hours in r.offsets.items():
        allowed = col("tz_offset_hours").isin(*hours) if hours else F.lit(False)
        stated = stated | ((col("source_system") == source) & ~allowed)
    cost = col("cost_cad")
    clocks = [("event", "event"), ("ingest", "ingest")]
    return [
        *((f"invalid_{n}_timestamp", col(f"{c}_ts_local").isNull()) for n, c in clocks),
        ("ingest_partition_mismatch", F.date_format("ingest_ts_local", "yyyy-MM") != col("source_partition")),
        ("unknown_source_system", ~col("source_system").isin(*r.offsets)),
        ("invalid_supplied_offset", col("tz_offset_hours").isNotNull() & stated),
        *((f"missing_{n}_timezone_rule", col(f"{c}_offset_count").isNull()) for n, c in clocks),
        *((f"{n}_nonexistent_local_time", col(f"{c}_offset_count") == 0) for n, c in clocks),
        *((f"unresolved_{n}_timezone", col(f"{c}_offset_hours").isNull()) for n, c in clocks),
        ("malformed_event_id", _misses("event_id", r.event_id)),
        ("malformed_case_id", col("case_id").isNull()),
        ("unknown_event_type", ~col("event_type").isin(*r.kinds)),
        ("invalid_site", ~col("site").isin(*r.sites)),
        ("malformed_clinician_id", _misses("clinician_id", r.clinician_id)),
        ("unmatched_clinician_id", col("dim_clinician_id").isNull()),
        ("malformed_ward_id", _misses("ward_id", r.ward_id)),
        ("clinician_dimension_mismatch", (col("dim_site") != col("site")) | (col("dim_ward_id") != col("ward_id"))),
        ("invalid_service_code", _misses("service_code", r.service)),
        ("service_site_mismatch", F.left("service_code", F.lit(1)) != col("site")),
        ("conflicting_service_codes", _code("raw_service_code") != _code("raw_svc_code")),
        ("missing_close_cost", (col("event_type") == r.closing_kind) & cost.isNull()),
        ("unexpected_event_cost", (col("event_type") != r.closing_kind) & cost.isNotNull()),
        ("cost_out_of_range", ~cost.between(r.least_cost, r.most_cost)),
        ("cost_not_cent_exact", F.abs(cost * 100 - F.round(cost * 100)) > 1e-6),
        ("negative_ingest_lag", col("ingest_ts_utc") < col("event_ts_utc")),
        ("ingest_lag_exceeds_contract", col("ingest_ts_utc") > col("event_ts_utc") + F.make_dt_interval(F.lit(r.most_lag_days))),
    ]


def rejection_reason(rules: EventRules) -> Column:
    """The first rule that an event breaks, null for one that is admitted."""
    return first_reason(*rejection_rules(rules))

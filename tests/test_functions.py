import math

import pytest
from pyspark.sql import functions as F

from tidewake.functions import identifiers as ids
from tidewake.functions import probability as prob
from tidewake.functions.timezones import resolve_offset, to_utc, valid_offsets


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, wanted", [(" 1 ", "C000000001"), ("c000000001", "C000000001"), ("C1", None), ("1234567890", None), (None, None), ("12\n", None)])
def test_case_ids(spark, raw, wanted):
    assert one(spark, ids.canonical_case_id(F.lit(raw).cast("string"))) == wanted


@pytest.mark.parametrize("wall, offsets", [("2026-03-08 02:30:00", []), ("2025-11-02 01:30:00", [-21600, -18000]), ("2026-01-05 12:00:00", [-21600])])
def test_offsets_of_gap_fold_and_normal_times(spark, wall, offsets):
    assert one(spark, valid_offsets(F.lit(wall).cast("timestamp_ntz"), "America/Chicago")) == offsets


def test_fold_resolves_by_stated_offset(spark):
    wall = F.lit("2025-11-02 01:30:00").cast("timestamp_ntz")
    for stated, wanted in ((-18000, "2025-11-02 06:30:00"), (-21600, "2025-11-02 07:30:00")):
        value, label = resolve_offset(valid_offsets(wall, "America/Chicago"), F.lit(stated), F.lit(False))
        assert one(spark, to_utc(wall, value).cast("string")) == wanted
        assert one(spark, label) == "stated_in_fold"
    value, label = resolve_offset(valid_offsets(wall, "America/Chicago"), F.lit(None).cast("int"), F.lit(False))
    assert one(spark, value) is None and one(spark, label) == "ambiguous_local_time"


def test_second_boundaries_are_counted(spark):
    a, b = (F.lit(f"2026-01-01 00:00:0{x}").cast("timestamp_ntz") for x in ("0.9", "1.1"))
    assert one(spark, ids.boundary_seconds(a, b)) == 1


def test_age_counts_completed_years_and_needs_a_birth_date(spark):
    day = lambda x: F.lit(x).cast("date")
    assert one(spark, ids.age_years(day("1980-06-02"), day("2020-06-01"))) == 39
    assert one(spark, ids.age_years(day("1980-06-01"), day("2020-06-01"))) == 40
    assert one(spark, ids.age_years(F.lit(None).cast("date"), day("2020-06-01"))) is None


def test_instants_need_an_offset(spark):
    assert one(spark, ids.offset_instant(F.lit("2026-01-01T10:00:00+02:00")).cast("string")) == "2026-01-01 08:00:00"
    assert one(spark, ids.offset_instant(F.lit("2026-01-01T10:00:00"))) is None
    assert one(spark, ids.offset_instant(F.lit("nonsense Z"))) is None


def test_normal_probabilities(spark):
    assert one(spark, prob.two_sided_p(F.lit(1.959963984540054))) == pytest.approx(0.05)
    assert one(spark, prob.normal_cdf(F.lit(0.0))) == 0.5
    assert one(spark, prob.exponential_rmst(F.lit(0.5), 10.0)) == pytest.approx(10 * 0.5 / math.log(2))
    assert one(spark, prob.e_value(F.lit(2.0))) == pytest.approx(2 + math.sqrt(2))


def test_offsets_and_elapsed_seconds_equal_the_standard_library(spark):
    from datetime import datetime, timedelta

    from tidewake.functions import timezones as tz

    walls = [datetime(2025, 11, 2, 0, 30) + timedelta(minutes=20 * i) for i in range(12)] + [datetime(2026, 3, 8, 0, 30) + timedelta(minutes=20 * i) for i in range(12)] + [datetime(2024, 7, 1)]
    df = spark.createDataFrame([(w,) for w in walls], "w timestamp_ntz")
    for zone in ("America/Chicago", "Europe/Berlin", "UTC", "Australia/Lord_Howe"):
        found = {r.w: r.o for r in df.select("w", tz.valid_offsets(F.col("w"), zone).alias("o")).collect()}
        assert all(found[w] == tz.scalar_offsets(w, zone) for w in walls)
    out = df.select("w", tz.elapsed(F.lit("2025-11-02 00:00:00").cast("timestamp_ntz"), F.lit(-18000), F.col("w"), F.lit(-21600)).alias("s")).collect()
    assert all(r.s == tz.scalar_elapsed(datetime(2025, 11, 2), -18000, r.w, -21600) for r in out)


def test_numbers_of_any_json(spark):
    from tidewake.functions.documents import json_numbers

    df = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": 2.5}]}, "d": "3"}'), (2, None), (3, "not json"), (4, "7"), (5, "[[], {}]")], "path int, v string")
    assert sorted((r.k, r.path, r.number) for r in json_numbers(df.withColumnRenamed("path", "k"), ["k"], "v").collect()) == [(1, "a.b[0]", 1.0), (1, "a.b[1].c", 2.5), (4, "", 7.0)]

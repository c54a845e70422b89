"""The monitoring core on a stream of scored cases."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewake.functions.identifiers import bounded, offset_instant, valid_commit, valid_token, week_start
from tidewake.operators import monitor
from tidewake.sources.store import Store
from tidewake.sources.versioned import Snapshot, VersionedTable

SCHEMA = """event_id string, case_id string, service_code string, site string, revision int, correction_of_event_id string, scored_at string, arrived_at string, outcome_observed_at string,
score double, threshold double, outcome int, numeric_features map<string,double>, data_version string, model_version string, prompt_version string, policy_version string, commit_sha string"""
EDGES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


def validated(df: DataFrame) -> DataFrame:
    """Instants as UTC wall clocks, and the first rule that a row breaks."""
    out = df.withColumns({f"{c}_utc": offset_instant(c) for c in ("scored_at", "arrived_at", "outcome_observed_at")})
    rules = [
        ("event_id", ~valid_token("event_id")), ("case_id", ~valid_token("case_id")), ("segment", ~(valid_token("service_code") & valid_token("site"))), ("revision", ~F.coalesce(F.col("revision") >= 1, F.lit(False))),
        ("score", ~bounded("score", 0.0, 1.0)), ("threshold", ~bounded("threshold", 0.0, 1.0)), ("outcome", F.col("outcome").isNotNull() & ~F.col("outcome").isin(0, 1)), ("scored_at", F.col("scored_at_utc").isNull()),
        ("arrived_at", F.col("arrived_at_utc").isNull() | (F.col("arrived_at_utc") < F.col("scored_at_utc"))), ("commit_sha", ~valid_commit("commit_sha")),
        ("outcome_observed_at", F.col("outcome").isNotNull() & F.col("outcome_observed_at_utc").isNull()),
    ]
    error = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        error = F.when(rule, F.lit(name)).otherwise(error)
    return out.withColumn("validation_error", error)


def content_of(df: DataFrame) -> DataFrame:
    features = F.to_json(F.array_sort(F.map_entries("numeric_features")))
    text = [F.coalesce(F.col(c).cast("string"), F.lit("<NULL>")) for c in df.columns if c != "numeric_features"] + [F.coalesce(features, F.lit("<NULL>"))]
    return df.withColumn("content_hash", F.sha2(F.concat_ws("|", *text).cast("binary"), 256))


SEGMENT = ("site", "service_code")
#: Sums of scores are decimals, so that what a correction takes out again leaves nothing behind.
_EXACT = "decimal(38,12)"
_CASE = f"{', '.join(f'{c} string' for c in ('case_id', 'event_id', *SEGMENT))}, revision int, scored_at_utc timestamp_ntz, score double, outcome int, content_hash string, model_version string, commit_sha string"
_SUMS = f"{', '.join(f'{c} string' for c in SEGMENT)}, week date, n bigint, n_mature bigint, events bigint, score_sum {_EXACT}, squares {_EXACT}, {', '.join(f'b{i} bigint' for i in range(len(EDGES) - 1))}"
_TABLES = {
    "events": (["event_id"], "event_id string, content_hash string"),
    "cases": (["case_id"], _CASE),
    "segments": (SEGMENT, f"{', '.join(f'{c} string' for c in SEGMENT)}, seen timestamp_ntz"),
    "weeks": (SEGMENT, _SUMS),
    "pending": (["due"], f"due date, {', '.join(f'{c} string' for c in SEGMENT)}, week date, mature_at timestamp_ntz, sign int, score double, outcome int"),
    "alerts": (["week"], f"week date, {', '.join(f'{c} string' for c in SEGMENT)}, n_mature bigint, mature_outcome_rate double, alert_id string, alert_hash string, state string"),
}


class ScoredCaseMonitor:
    """Accepts batches of events and projects metrics and alerts; each batch is applied once, by its number.

    What a batch needs of the past is kept by key (``VersionedTable``): ids of accepted events, the active
    revision of each case, the latest scoring time of each segment, weekly sums, contributions whose outcome
    hasn't matured, and alerts by week. A batch reads and writes the buckets that it touches: a revision takes the
    former one's contribution out of its week and puts its own in, an advance of the watermark releases what has
    matured, and only the alerts of weeks whose candidates change are dispatched anew. All tables move in one
    step, with the batch number, when ``state.json`` is replaced; a batch that fails before that is run again on the
    former state. ``metrics`` and ``project`` compute the same from all accepted events, for checks.
    """

    def __init__(self, spark: SparkSession, location: str, threshold: float = 0.4, baseline_weeks: int = 2, persistence: int = 2, budget: int = 3, matured_days: int = 7, late_days: int = 10, buckets: int = 64, most_parts: int = 16):
        self.spark, self.store = spark, Store(spark, location)
        self.threshold, self.baseline_weeks, self.persistence, self.budget, self.matured_days, self.late_days = threshold, baseline_weeks, persistence, budget, matured_days, late_days
        self.tables = {n: VersionedTable(spark, self.store.at(f"tables/{n}"), key, schema, buckets) for n, (key, schema) in _TABLES.items()}
        self.most_parts = most_parts

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.store.at(name))

    def _state(self) -> dict:
        return self.store.read_json("state.json", {"batch": -1, "watermark": None, "tables": {}})

    def _read(self, state: dict, name: str, keys: DataFrame | None = None) -> DataFrame:
        """Rows of a table, of all keys or of the buckets that some keys touch."""
        table, at = self.tables[name], Snapshot.from_json(state["tables"].get(name))
        return table.read(at, None if keys is None else table.touched(keys))

    def apply(self, batch: DataFrame, number: int) -> None:
        """Validate, tell new from replayed and conflicting events, take revisions in sequence, then move sums and alerts by what is new.

        Accepted and refused rows and changes of alerts are folders named by the batch, so that a batch that is run again
        replaces its own.
        """
        state = self._state()
        if number <= state["batch"]:
            return
        tables, at = self.tables, {n: Snapshot.from_json(state["tables"].get(n)) for n in self.tables}
        rows = self._kept(content_of(validated(batch)).drop("content_hash").withColumn("content_hash", rows_hash()), number, "rows")
        good = rows.filter("validation_error IS NULL")
        arrival = ["arrived_at_utc"]
        told = monitor.classify_replays(good.drop("content_hash"), self._read(state, "events", good), "event_id", rows_hash(), arrival)
        told = self._kept(told, number, "told")
        cases = self._kept(monitor.active_revisions(self._read(state, "cases", told).join(told.select("case_id").distinct(), "case_id", "left_semi"), ["case_id"], "revision", "event_id"), number, "cases")
        new = monitor.follow_on(told.filter("status = 'new'").drop("status"), cases, ["case_id"], "revision", "event_id", "correction_of_event_id", arrival)
        # flags of the order of arrival, carried on from all that came before
        seen = self._read(state, "segments", told).select(*(F.col(c).alias(f"_{c}") for c in SEGMENT), F.col("seen").alias("_seen"))
        new = new.join(seen, [F.col(c) == F.col(f"_{c}") for c in SEGMENT], "left")
        taken = monitor.late_and_backfilled(new.filter("sequence_ok").drop("sequence_ok"), "scored_at_utc", "arrived_at_utc", "event_id", self.late_days, SEGMENT, F.col("_seen")).drop("_seen", *(f"_{c}" for c in SEGMENT))
        self._write(taken, f"accepted/batch={number}")
        refused = lambda df, reason: df.select("event_id", "content_hash", reason.alias("reason"))
        bad = refused(told.filter("status = 'conflict'"), F.lit("conflict")).unionByName(refused(new.filter("NOT sequence_ok"), F.lit("sequence"))).unionByName(refused(rows.filter("validation_error IS NOT NULL"), F.col("validation_error")))
        self._write(bad, f"rejected/batch={number}")
        taken = self._table(f"accepted/batch={number}")
        latest = taken.agg(F.max("arrived_at_utc")).first()[0]
        before, now = state["watermark"], max(filter(None, (state["watermark"], latest and latest.isoformat())), default=None)
        if latest is not None:
            at["events"] = tables["events"].append(at["events"], taken.select("event_id", "content_hash"))
            after = monitor.active_revisions(taken, ["case_id"], "revision", "event_id")
            at["cases"] = tables["cases"].append(at["cases"], after)
            both = self._read(state, "segments", taken).unionByName(taken.select(*SEGMENT, F.col("scored_at_utc").alias("seen")))
            at["segments"] = tables["segments"].replace(at["segments"], both.groupBy(*SEGMENT).agg(F.max("seen").alias("seen")), tables["segments"].touched(taken))
            former = cases.join(after.select("case_id"), "case_id", "left_semi")
            self._move(number, at, self._contributions(after, 1).unionByName(self._contributions(former, -1)), before, now)
        else:
            self._write(self.spark.createDataFrame([], "alert_id string, step int, action string, alert_hash string"), f"history/batch={number}")
        at = {n: tables[n].compact(s, self.most_parts) for n, s in at.items()}
        self.store.write_json("state.json", {"batch": number, "watermark": now, "tables": {n: s.to_json() for n, s in at.items()}})
        for name, table in tables.items():
            table.vacuum([at[name]])
        self.store.delete("work")

    def _kept(self, df: DataFrame, number: int, name: str) -> DataFrame:
        """A step of a batch, written once and read by all that follows."""
        self._write(df, f"work/{number}/{name}")
        return self._table(f"work/{number}/{name}")

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(self.store.at(name))

    def _contributions(self, cases: DataFrame, sign: int) -> DataFrame:
        """What active revisions add to, or take from, their segment's week."""
        mature = F.col("scored_at_utc") + F.make_dt_interval(F.lit(self.matured_days))
        return cases.select(*SEGMENT, week_start("scored_at_utc").alias("week"), mature.alias("mature_at"), F.lit(sign).alias("sign"), "score", "outcome")

    def _move(self, number: int, at: dict[str, Snapshot], changes: DataFrame, before: str | None, now: str) -> None:
        """Weekly sums, pending contributions and alerts after contributions have changed and the watermark has moved; ``at`` is brought up to date."""
        tables, upto = self.tables, F.lit(now).cast("timestamp_ntz")
        changes = self._kept(changes, number, "changes")
        due = F.col("outcome").isNotNull() & (F.col("mature_at") <= upto)
        # of the days between both watermarks, and of contributions to come
        later = changes.filter("outcome IS NOT NULL").filter(~due).withColumn("due", F.to_date("mature_at"))
        first = before[:10] if before else now[:10]
        days = self.spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(now[:10]).cast("date"))).alias("due"))
        passed = tables["pending"].touched(days)
        held = tables["pending"].read(at["pending"], passed)
        released = self._kept(held.filter(F.col("mature_at") <= upto).drop("due"), number, "released")
        rest = held.filter(F.col("mature_at") > upto)
        at["pending"] = tables["pending"].append(tables["pending"].replace(at["pending"], rest, passed), later.select(*(f.name for f in rest.schema.fields)))
        counted = changes.select("*", F.lit(True).alias("counts"), due.alias("is_due")).unionByName(released.select("*", F.lit(False).alias("counts"), F.lit(True).alias("is_due")))
        s, apart = F.col("sign").cast("long"), F.col("score") - F.col("outcome")
        bins = {f"b{i}": F.when(F.col("counts") & (monitor.score_bin("score", EDGES) == i), s).otherwise(0) for i in range(len(EDGES) - 1)}
        delta = counted.select(
            *SEGMENT, "week", F.when(F.col("counts"), s).otherwise(0).alias("n"), F.when(F.col("is_due"), s).otherwise(0).alias("n_mature"), F.when(F.col("is_due"), s * F.col("outcome")).otherwise(0).alias("events"),
            (F.when(F.col("is_due"), F.col("score")).otherwise(0.0).cast(_EXACT) * s).cast(_EXACT).alias("score_sum"), (F.when(F.col("is_due"), apart * apart).otherwise(0.0).cast(_EXACT) * s).cast(_EXACT).alias("squares"), *(c.alias(n) for n, c in bins.items()),
        )
        delta = self._kept(self._summed(delta), number, "delta")
        touched = tables["weeks"].touched(delta)
        old = tables["weeks"].read(at["weeks"], touched)
        at["weeks"] = tables["weeks"].replace(at["weeks"], self._summed(old.unionByName(delta)).filter("n > 0"), touched)
        segments = delta.select(*SEGMENT).distinct()
        own = lambda sums: self._candidates(sums.join(segments, list(SEGMENT), "left_semi"))
        was, becomes = self._kept(own(old), number, "was"), self._kept(own(tables["weeks"].read(at["weeks"], touched)), number, "becomes")
        weeks = self._kept(was.exceptAll(becomes).unionByName(becomes.exceptAll(was)).select("week").distinct(), number, "weeks")
        buckets = tables["alerts"].touched(weeks)
        there = tables["alerts"].read(at["alerts"], buckets)
        stand = there.join(weeks, "week", "left_semi")
        others = stand.join(segments, list(SEGMENT), "left_anti").select(*becomes.columns)
        dispatched = self._dispatched(others.unionByName(becomes.join(weeks, "week", "left_semi").select(*becomes.columns)))
        dispatched = self._kept(dispatched.select(*there.columns), number, "dispatched")
        fired = lambda df: df.filter("state = 'fired'").select("alert_id", "alert_hash")
        self._write(monitor.ledger_changes(fired(stand), fired(dispatched), "alert_id", "alert_hash"), f"history/batch={number}")
        at["alerts"] = tables["alerts"].replace(at["alerts"], there.join(weeks, "week", "left_anti").select(*there.columns).unionByName(dispatched), buckets)

    def _summed(self, rows: DataFrame) -> DataFrame:
        keys = [*SEGMENT, "week"]
        total = lambda c: F.sum(c).cast(_EXACT if c in ("score_sum", "squares") else "long").alias(c)
        return rows.groupBy(*keys).agg(*(total(c) for c in rows.columns if c not in keys))

    def _accepted(self, upto: int) -> DataFrame | None:
        folders = [f"accepted/batch={i}" for i in range(upto + 1) if self.store.exists(f"accepted/batch={i}")]
        return self.spark.read.parquet(*(self.store.at(f) for f in folders)) if folders else None

    def history(self) -> DataFrame:
        """Every change to the alerts, in order."""
        return self.spark.read.option("basePath", self.store.at("history")).parquet(self.store.at("history")).orderBy("batch", "alert_id", "step")

    def current_alerts(self) -> DataFrame:
        """The alerts whose last change fired them."""
        return monitor.active_alerts(self.history(), "alert_id", "alert_hash")

    def current_metrics(self, wanted: dict[str, object] | None = None) -> DataFrame:
        """Weekly metrics from the sums that are kept, filtered by site, service or week."""
        return monitor.equal_filters(self._measured(self._read(self._known(), "weeks")), wanted or {}, ["week", *SEGMENT])

    def current_states(self) -> DataFrame:
        """Every candidate for an alert and what became of it: fired, bundled or over budget."""
        return self._read(self._known(), "alerts")

    def provenance(self, wanted: dict[str, object] | None = None) -> DataFrame:
        """The events behind each weekly metric."""
        rows = monitor.active_revisions(self._read(self._known(), "cases"), ["case_id"], "revision", "event_id").withColumn("week", week_start("scored_at_utc"))
        return monitor.provenance_inputs(rows, ["week", *SEGMENT], ["event_id", "revision", "content_hash", "model_version", "commit_sha"], wanted)

    def snapshot(self) -> DataFrame:
        """The latest week of each segment, with its measures and the state of its alert, if any."""
        nth = F.row_number().over(Window.partitionBy(*SEGMENT).orderBy(F.desc("week")))
        last = self.current_metrics().withColumn("_nth", nth).filter("_nth = 1").drop("_nth")
        return last.join(self.current_states().select("week", *SEGMENT, "state"), ["week", *SEGMENT], "left")

    def catalog(self) -> DataFrame:
        """The measures that are watched: what each compares, and the rule that makes it an alert."""
        rule = f"at least {self.threshold} in {self.persistence} weeks running, {self.budget} alerts a week"
        rows = [("score_psi", f"scores of the week with those of the {self.baseline_weeks} observed weeks before", None), ("brier_score", "matured outcomes", None), ("calibration_gap", "matured outcomes", None), ("mature_outcome_rate", "matured outcomes", rule), ("mature_outcome_rate_delta", f"matured outcomes with those of the {self.baseline_weeks} observed weeks before", None)]
        return self.spark.createDataFrame(rows, "metric string, compares string, alert_rule string")

    def health(self) -> dict:
        """The last batch, the watermark, and the version and folders of each table."""
        state = self._state()
        return {"batch": state["batch"], "watermark": state["watermark"], "tables": {n: {"version": t["version"], "buckets": len(t["parts"]), "folders": sum(map(len, t["parts"].values()))} for n, t in state["tables"].items()}}

    def _known(self) -> dict:
        state = self._state()
        if state["batch"] < 0:
            raise ValueError("no batch was applied")
        return state

    def _measured(self, sums: DataFrame) -> DataFrame:
        real = sums.withColumns({c: F.col(c).cast("double") for c in ("events", "score_sum", "squares")})
        return monitor.metrics_of_sums(real, "week", SEGMENT, len(EDGES) - 1, self.baseline_weeks)

    def _candidates(self, sums: DataFrame) -> DataFrame:
        """Breaches that persist."""
        return self._persisting(self._measured(sums)).select("week", *SEGMENT, "n_mature", "mature_outcome_rate")

    def _persisting(self, metrics: DataFrame) -> DataFrame:
        m = metrics.withColumn("breach", F.coalesce(F.col("mature_outcome_rate") >= self.threshold, F.lit(False)))
        return monitor.streaks(m, SEGMENT, "week", "breach").filter(F.col("streak") >= self.persistence)

    def _dispatched(self, candidates: DataFrame) -> DataFrame:
        """Candidates bundled and within the weekly budget, under ids and with hashes of their own."""
        m = monitor.dispatch_alerts(candidates, "week", ["site"], "mature_outcome_rate", "service_code", self.budget)
        ident = F.concat_ws("/", F.col("week").cast("string"), *SEGMENT)
        return m.withColumns({"alert_id": ident, "alert_hash": F.sha2(F.concat_ws("|", ident, F.col("n_mature").cast("string"), F.round("mature_outcome_rate", 9).cast("string")).cast("binary"), 256)})

    # ---- the same from all accepted events

    def metrics(self, accepted: DataFrame) -> DataFrame:
        rows = monitor.active_revisions(accepted, ["case_id"], "revision", "event_id").withColumn("week", week_start("scored_at_utc"))
        rows = rows.crossJoin(F.broadcast(accepted.agg(F.max("arrived_at_utc").alias("watermark"))))
        matured = F.col("scored_at_utc") + F.make_dt_interval(F.lit(self.matured_days)) <= F.col("watermark")
        return monitor.weekly_metrics(rows, "week", SEGMENT, "score", "outcome", matured, self.baseline_weeks, EDGES)

    def project(self, accepted: DataFrame) -> DataFrame:
        """alert_id, alert_hash and state of what should be alerted now: breaches that persist, bundled and within the weekly budget."""
        return self._dispatched(self._persisting(self.metrics(accepted))).select("alert_id", "alert_hash", "state")


def rows_hash():
    """The content of an event as its columns of the incoming schema."""
    names = [p.split()[0] for p in SCHEMA.replace("\n", " ").replace("map<string,double>", "map").split(",")]
    features = F.to_json(F.array_sort(F.map_entries("numeric_features")))
    return F.sha2(F.concat_ws("|", *(F.coalesce(features if n == "numeric_features" else F.col(n).cast("string"), F.lit("<NULL>")) for n in names)).cast("binary"), 256)


def start(spark: SparkSession, source: str, monitor_: ScoredCaseMonitor, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Reads JSON files as they come, all that are there at once, and applies them batch by batch."""
    events = spark.readStream.schema(SCHEMA).json(source)
    return events.writeStream.foreachBatch(on_batch or monitor_.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_counts(events: DataFrame, late: str = "30 days", keys: Sequence[str] = ("site", "service_code")) -> DataFrame:
    """Tumbling ISO weeks of a stream by event time, for dashboards that may forget what comes later than ``late``."""
    timed = events.withColumn("scored_ts", offset_instant("scored_at").cast("timestamp")).withWatermark("scored_ts", late)
    return timed.groupBy(F.window("scored_ts", "7 days", startTime="4 days"), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))

"""Runs a statement under bounds of time, rows made and bytes read, and stops it when it passes one.

Spark's own metrics of the running plan are looked at: the rows that any node has made so far and the bytes
that its stages have read. Executors report them when a task ends and with each heartbeat
(``spark.executor.heartbeatInterval``), so a statement can run past a bound for as long as one heartbeat.
What a statement did is looked at once more after its end, so whether it is refused doesn't depend on when
it was looked at.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tidewake.plans.plan_bounds import each

#: Seconds between two looks, and how long the last one waits for reports under way.
LOOK_SECONDS, SETTLE_MILLIS = 0.2, 10_000
_ROWS = "number of output rows"
#: What ``setJobGroup`` sets for a thread.
_OF_THREAD = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")


@dataclass(frozen=True)
class Usage:
    """The most rows that a node of the plan has made, and the bytes that all stages have read."""

    rows: int = 0
    read_bytes: int = 0


class Stopped(RuntimeError):
    """A statement passed a bound; the message names it."""


def usage_of(session: SparkSession, tag: str) -> Usage:
    """What the statements that run, or ran, with a tag as their description have made and read so far."""
    sql, stages = session._jsparkSession.sharedState().statusStore(), session.sparkContext._jsc.sc().statusStore()
    rows = read = 0
    count = sql.executionsCount()
    # the newest executions: those of other statements at the same time stand between them
    for execution in each(sql.executionsList(max(count - 200, 0), 200)):
        if execution.description() != tag:
            continue
        number = execution.executionId()
        values = sql.executionMetrics(number)
        for node in each(sql.planGraph(number).allNodes()):
            for metric in each(node.metrics()):
                if metric.name() == _ROWS and values.contains(metric.accumulatorId()):
                    found = values.apply(metric.accumulatorId()).split("\n")[-1].split(" ")[0].replace(",", "")
                    rows = max(rows, int(found) if found.isdigit() else 0)
        for stage in each(execution.stages().toSeq()):
            try:
                read += stages.lastStageAttempt(stage).inputBytes()
            except (Py4JJavaError, PySparkException):  # not submitted yet, or not needed: nothing read
                continue
    return Usage(rows, read)


def run(session: SparkSession, frame: DataFrame, fetch: Callable[[DataFrame], list], seconds: float, made_rows: int, read_bytes: int) -> tuple[list, Usage]:
    """``fetch(frame)`` and what it took; raises ``Stopped`` with ``seconds``, ``rows made`` or ``bytes read``."""
    tag, began = f"watched-{uuid.uuid4().hex}", time.monotonic()
    done, passed = threading.Event(), []

    def broken(used: Usage) -> str | None:
        return "rows made" if used.rows > made_rows else "bytes read" if used.read_bytes > read_bytes else None

    def look() -> None:
        while not done.wait(LOOK_SECONDS):
            rule = "seconds" if time.monotonic() - began > seconds else None
            try:
                rule = rule or broken(usage_of(session, tag))
            except (Py4JJavaError, PySparkException):  # a plan that isn't entered yet: the next look, or the last one, tells
                pass
            if rule:
                if not passed:
                    passed.append(rule)
                session.sparkContext.cancelJobGroup(tag)  # again at each look: jobs may start in between

    watcher = threading.Thread(target=look, daemon=True)
    context = session.sparkContext
    former = {p: context.getLocalProperty(p) for p in _OF_THREAD}
    context.setJobGroup(tag, tag, interruptOnCancel=True)
    watcher.start()
    try:
        rows = fetch(frame)
    except Exception as e:
        if passed:
            raise Stopped(passed[0]) from e
        raise
    finally:
        done.set()
        watcher.join()
        for name, value in former.items():
            context.setLocalProperty(name, value)
    context._jsc.sc().listenerBus().waitUntilEmpty(SETTLE_MILLIS)
    used = usage_of(session, tag)
    if rule := passed[0] if passed else broken(used):
        raise Stopped(rule)
    return rows, used

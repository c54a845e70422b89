"""Guarded read-only SQL over one scoped view for each principal.

A principal's rows and columns are filtered in an isolated session that knows a single view,
``cases``. A statement passes a text check, then is parsed by Spark itself, and the plan is walked
node by node: it must be one query, read ``cases`` (or its own common table expressions) and
nothing else, call only listed functions and hold only listed expressions. Names are a first look:
once the statement is analyzed, every leaf of its plan must be the scope's own files. The optimized
plan is then bounded node by node (``plan_bounds``) with the figures of those files, and a statement
that could make more rows than the ceiling, in whatever joins, is refused. Only then does it run,
watched while it runs and stopped at bounds of time, rows made and bytes read (``watch``), and with its rows,
columns and cells capped. Answers say
where they come from, and every statement leaves an audit row of hashes and counts, admitted or not.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
import re
import time
import unicodedata
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.plans import watch
from tidewake.plans.plan_bounds import NoBound, PlanBounds, TableFigures, each, figures_of, kind_of

VIEW = "cases"
_DENIED = re.compile(r"\b(insert|update|delete|merge|drop|create|alter|truncate|set|reset|use|cache|uncache|refresh|add|load|describe|show|explain|analyze|call|grant|revoke|copy|attach|pragma)\b|\binformation_schema\b|\bsystem\b|`", re.I)
#: Functions that a statement may call, by the names that Spark's parser leaves unresolved.
ALLOWED_FUNCTIONS = frozenset("count sum avg mean min max round floor ceil abs coalesce nullif upper lower trim length substr substring year month day date_trunc percentile median stddev stddev_samp variance row_number rank dense_rank lag lead if ifnull when case cast and or not between in like concat count_if bool_or bool_and + - * / % = == != <> < > <= >= isnull isnotnull unary_minus negative".split())
#: Classes of expressions that an analyzed statement may hold; what isn't listed is refused, whatever it was called.
ALLOWED_EXPRESSIONS = frozenset("""AttributeReference Alias Literal Cast Add Subtract Multiply Divide Remainder UnaryMinus EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual Not And Or In InSubquery ListQuery ScalarSubquery Exists
OuterReference IsNull IsNotNull CaseWhen If Coalesce NullIf Nvl Between AggregateExpression Count Sum Average Min Max Round Floor Ceil Abs Upper Lower StringTrim Length Substring Year Month DayOfMonth TruncTimestamp Percentile Median StddevSamp VarianceSamp
CountIf BoolOr BoolAnd RowNumber Rank DenseRank Lag Lead WindowExpression WindowSpecDefinition SpecifiedWindowFrame UnspecifiedFrame$ UnboundedPreceding$ UnboundedFollowing$ CurrentRow$ SortOrder Like Concat Complete$ TempResolvedColumn LateralColumnAliasReference With CommonExpressionDef CommonExpressionRef TypedNullLiteral""".split())
_QUERY_PLAN, _EXPRESSION = "org.apache.spark.sql.catalyst.plans.QueryPlan", "org.apache.spark.sql.catalyst.expressions.Expression"


class Refused(ValueError):
    """A statement or identity that isn't admitted; the message names the rule."""


@dataclass(frozen=True)
class Scope:
    """What a principal may see; empty lists of sites admit nothing."""

    name: str
    columns: tuple[str, ...]
    sites: tuple[str, ...]
    services: tuple[str, ...] | None = None
    first_day: str = "0001-01-01"
    last_day: str = "9999-12-31"


@dataclass(frozen=True)
class Limits:
    characters: int = 4000
    rows: int = 100
    columns: int = 32
    cell_characters: int = 512
    scans: int = 4
    possible_rows: int = 10_000_000
    seconds: float = 30.0
    #: Rows that a node of the running plan may make, and bytes that its stages may read.
    made_rows: int = 10_000_000
    read_bytes: int = 1 << 36


@dataclass
class Answer:
    columns: list[str]
    rows: list[list]
    truncated: bool
    scope: str
    statement: str = field(repr=False, default="")
    #: Versions and digests of what the answer rests on, and the bounds under which it ran.
    provenance: dict = field(repr=False, default_factory=dict)


def scoped(source: DataFrame, scope: Scope, site: str = "site", service: str = "service", day: str = "referral_date") -> DataFrame:
    """The rows and columns of a principal: sites, services that belong to their site, and days."""
    rows = source.filter(F.col(site).isin(list(scope.sites))) if scope.sites else source.filter(F.lit(False))
    rows = rows.filter(F.col(service).startswith(F.concat(F.col(site), F.lit("-"))))
    if scope.services is not None:
        rows = rows.filter(F.col(service).isin(list(scope.services)))
    return rows.filter(F.col(day).between(F.lit(scope.first_day).cast("date"), F.lit(scope.last_day).cast("date"))).select(*scope.columns)


def scope_breaches(rows: DataFrame, scope: Scope, site: str = "site", service: str = "service", day: str = "referral_date") -> DataFrame:
    """Counts of rows that a scope shouldn't hold; all must be zero. Days are looked at where the scope shows them."""
    foreign = ~F.col(service).isin(list(scope.services)) if scope.services is not None else F.lit(False)
    other_day = ~F.coalesce(F.col(day).between(F.lit(scope.first_day).cast("date"), F.lit(scope.last_day).cast("date")), F.lit(False)) if day in rows.columns else F.lit(False)
    return rows.agg(F.count_if(~F.col(site).isin(list(scope.sites) or [""])).alias("foreign_site"), F.count_if(foreign).alias("foreign_service"), F.count_if(other_day).alias("foreign_day"))


def check_text(sql: str, limits: Limits) -> None:
    if not sql.strip() or len(sql) > limits.characters:
        raise Refused("length")
    if unicodedata.normalize("NFKC", sql) != sql or not sql.isascii() or any(ord(c) < 32 and c not in "\n\t\r" for c in sql):
        raise Refused("characters")
    # as Spark reads literals: a backslash takes the next character with it, two quotes in a row go on
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", sql, flags=re.S)
    if ";" in bare or "--" in bare or "/*" in bare:
        raise Refused("separator or comment")
    if m := _DENIED.search(bare):
        raise Refused(f"word {m[0]!r}")


def nodes(session: SparkSession, plan) -> Iterator[tuple[str, object, bool]]:
    """(class, node, whether it is an expression) of a plan, its subqueries and their expressions."""
    gateway, left = session.sparkContext._gateway, [plan]
    while left:
        node = left.pop()
        expression = is_instance_of(gateway, node, _EXPRESSION)
        yield node.getClass().getSimpleName(), node, expression
        left += each(node.children())
        if not expression:
            left += each(node.expressions())
            left += [x for x in each(node.innerChildren()) if is_instance_of(gateway, x, _QUERY_PLAN)]
        elif is_instance_of(gateway, node, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
            left.append(node.plan())


#: Leaves that read no data: a row without columns, rows that the optimizer has worked out, and common table expressions, which stand in the same plan.
_DATALESS = frozenset("OneRowRelation LocalRelation CTERelationRef".split())


@dataclass(frozen=True)
class ScopeTable:
    """The written rows of a scope: the only files that a statement may read, and their figures."""

    path: str
    figures: TableFigures
    digest: str


def write_scope(rows: DataFrame, path: str) -> ScopeTable:
    """Rows of a scope written under ``path``, with the digest of what they hold, in whatever order."""
    rows.write.parquet(path)
    table = rows.sparkSession.read.parquet(path)
    text = F.sha2(F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"}).cast("binary"), 256)
    parts = table.agg(F.count(F.lit(1)), *(F.sum(F.conv(F.substring(text, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4))).first()
    return ScopeTable(path, figures_of(table), _hash([str(p) for p in parts]))


def _files(relation) -> set[str]:
    """Root paths of a relation over files; none for any other relation."""
    of = relation.relation()
    return {p.toString() for p in each(of.location().rootPaths())} if kind_of(of) == "HadoopFsRelation" else set()


def check_plan(session: SparkSession, sql: str, limits: Limits, scope: ScopeTable) -> PlanBounds:
    """Rules on the statement as Spark parses, analyzes and optimizes it; what it can make and read."""
    state = session._jsparkSession.sessionState()
    try:
        parsed = state.sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused("syntax") from e
    found = list(nodes(session, parsed))
    own = {VIEW}
    for kind, node, _ in found:
        if kind == "UnresolvedWith":
            if node.allowRecursion():
                raise Refused("recursion")
            own |= {x._1().lower() for x in each(node.cteRelations())}
    for kind, node, expression in found:
        if not expression and re.search(r"Command|Insert|Drop|Create|Set|Replace|Alter|Cache|InlineTable|LocalRelation|ScriptTransformation|TableValuedFunction|TVF|Generate|Describe|Show", kind):
            raise Refused("not a query")
        if kind == "UnresolvedRelation":
            name = ".".join(each(node.multipartIdentifier())).lower()
            if name not in own:
                raise Refused(f"relation {name!r}")
        if kind == "UnresolvedFunction":
            name = ".".join(each(node.nameParts())).lower()
            if name not in ALLOWED_FUNCTIONS:
                raise Refused(f"function {name!r}")
    try:
        execution = session.sql(sql)._jdf.queryExecution()
        analyzed = execution.analyzed()
    except Exception as e:
        raise Refused("analysis") from e
    allowed = {session.sparkContext._jvm.org.apache.hadoop.fs.Path(scope.path).toUri().getPath()}
    reads = 0
    for kind, node, expression in nodes(session, analyzed):
        if expression and kind not in ALLOWED_EXPRESSIONS:
            raise Refused(f"expression {kind!r}")
        # whatever a name meant, the files behind it must be those of the scope
        if not expression and not node.children().length() and kind not in _DATALESS:
            paths = {session.sparkContext._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath() for p in _files(node)} if kind == "LogicalRelation" else set()
            if not paths or paths != allowed:
                raise Refused("data outside the scope")
            reads += 1
    if reads > limits.scans:
        raise Refused("scans")
    bounds = PlanBounds(session, scope.figures)
    try:
        bounds.visit(execution.optimizedPlan())
    except NoBound as e:
        raise Refused(f"node {str(e)!r}") from e
    except Exception as e:
        raise Refused("analysis") from e
    if bounds.scans > limits.scans:
        raise Refused("scans")
    if max(bounds.largest, bounds.scans * scope.figures.rows) > limits.possible_rows:
        raise Refused("possible rows")
    return bounds


def cell(value, limits: Limits):
    """A value as plain data: no NaN or infinity, decimals as floats, dates as ISO text, long texts cut."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, Decimal):
        return float(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value[: limits.cell_characters] if isinstance(value, str) else value


class GuardedQueries:
    """Answers statements of one principal in a session of its own; ``audit`` takes a row for each."""

    def __init__(self, spark: SparkSession, rows: DataFrame, scope: Scope, location: str, limits: Limits = Limits(), audit: Callable[[dict], None] | None = None, policy_version: str = "1", commit: str = "unavailable"):
        self.scope, self.limits, self.audit, self.policy_version, self.commit = scope, limits, audit, policy_version, commit
        self.table = write_scope(rows, f"{location.rstrip('/')}/scope-{uuid.uuid4().hex}")
        self.session = spark.newSession()
        self.session.read.parquet(self.table.path).createOrReplaceTempView(VIEW)
        self.session.conf.set("spark.sql.runSQLOnFiles", "false")

    def close(self) -> None:
        """Deletes the written rows of the scope; no statement can be answered afterwards."""
        where = self.session.sparkContext._jvm.org.apache.hadoop.fs.Path(self.table.path)
        where.getFileSystem(self.session.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def answer(self, sql: str) -> Answer:
        began, out, reason = time.time(), None, None
        try:
            out = self._answer(sql)
            return out
        except Refused as e:
            reason = str(e)
            raise
        finally:
            if self.audit:
                self.audit(audit_row(self.scope, sql, out, reason, time.time() - began))

    def ask(self, question: str, provider: Callable[[str, Sequence[str]], tuple[str, str | None]]) -> Answer:
        """The answer to a question that a provider puts into SQL; its SQL is checked like any other."""
        decision, sql = provider(question, self.scope.columns)
        if decision != "answer" or sql is None:
            raise Refused(decision)
        return self.answer(sql)

    def _answer(self, sql: str) -> Answer:
        check_text(sql, self.limits)
        bounds = check_plan(self.session, sql, self.limits, self.table)
        frame = self.session.sql(sql)
        names = frame.columns
        if len(names) > self.limits.columns or len({n.lower() for n in names}) < len(names) or not all(_LABEL.fullmatch(n) for n in names):
            raise Refused("columns")
        limits = self.limits
        try:
            found, used = watch.run(self.session, frame, lambda f: f.limit(limits.rows + 1).collect(), limits.seconds, limits.made_rows, limits.read_bytes)
        except watch.Stopped as e:
            raise Refused(f"stopped: {e}") from e
        except Exception as e:
            raise Refused("failure") from e
        kept = found[: self.limits.rows]
        return Answer(frame.columns, [[cell(v, self.limits) for v in r] for r in kept], len(found) > len(kept), self.scope.name, sql, self._provenance(sql, bounds, used))

    def _provenance(self, sql: str, bounds: PlanBounds, used: watch.Usage) -> dict:
        return {
            "policy_version": self.policy_version, "commit": self.commit, "statement_sha256": hashlib.sha256(sql.encode()).hexdigest(), "scope_sha256": scope_digest(self.scope), "data_sha256": self.table.digest,
            "scope_rows": self.table.figures.rows, "scans": bounds.scans, "possible_rows": bounds.largest, "made_rows": used.rows, "read_bytes": used.read_bytes, "limits": dataclasses.asdict(self.limits),
        }


#: Names of result columns: letters, digits and underscores.
_LABEL = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,63}")


def _hash(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str, separators=(",", ":")).encode()).hexdigest()


def scope_digest(scope: Scope) -> str:
    return _hash([scope.columns, scope.sites, scope.services, scope.first_day, scope.last_day])


def audit_row(scope: Scope, sql: str, answer: Answer | None, reason: str | None, seconds: float) -> dict:
    """What happened to a statement, in hashes and counts: neither its text nor its rows."""
    return {
        "principal_sha256": _hash(scope.name), "scope_sha256": scope_digest(scope), "statement_sha256": hashlib.sha256(sql.encode()).hexdigest(), "admitted": answer is not None,
        "reason": reason, "rows": len(answer.rows) if answer else None, "truncated": answer.truncated if answer else None, "rows_sha256": _hash(answer.rows) if answer else None, "millis": round(seconds * 1000),
    }


def load_policy(policy: dict) -> dict[str, Scope]:
    """Scopes by principal from ``{"version": 1, "principals": {name: {...}}}``; unknown or missing fields, wrong types and empty lists are refused."""
    if set(policy) != {"version", "principals"} or policy["version"] != 1 or not isinstance(policy["principals"], dict):
        raise ValueError("policy: version 1 with principals")
    out = {}
    for name, p in policy["principals"].items():
        required, known = {"columns", "sites"}, {"columns", "sites", "services", "first_day", "last_day"}
        if not isinstance(p, dict) or not required <= set(p) <= known:
            raise ValueError(f"policy of {name!r}: fields")
        for k in ("columns", "sites", "services"):
            v = p.get(k)
            if (v is not None or k != "services") and not (isinstance(v, list) and v and all(isinstance(x, str) and x for x in v) and len(set(v)) == len(v)):
                raise ValueError(f"policy of {name!r}: {k}")
        if p.get("services") and not all(any(s.startswith(f"{site}-") for site in p["sites"]) for s in p["services"]):
            raise ValueError(f"policy of {name!r}: a service outside its sites")
        days = [date.fromisoformat(p.get(k, d)) for k, d in (("first_day", "0001-01-01"), ("last_day", "9999-12-31"))]
        if days[0] > days[1]:
            raise ValueError(f"policy of {name!r}: days")
        out[name] = Scope(name, tuple(p["columns"]), tuple(p["sites"]), tuple(p["services"]) if p.get("services") else None, *(d.isoformat() for d in days))
    return out


#: What questions can ask for, and how it is computed.
MEASURES = {"count": "count(*)", "cancellation rate": "avg(CAST(cancellation_proxy AS INT))", "mean readiness": "avg(readiness_days)", "mean cost": "avg(total_cost_cad)"}
GROUPS = {"": (), "by site": ("site",), "by service": ("service_code",), "by site and service": ("site", "service_code")}


def template_sql(measure: str, group: str = "") -> str:
    keys = ", ".join(GROUPS[group])
    sql = f"SELECT {keys + ', ' if keys else ''}{MEASURES[measure]} AS answer FROM {VIEW}"
    return sql + (f" GROUP BY {keys}" if keys else "")


def question_sql(question: str, allowed: Sequence[str]) -> tuple[str, str | None]:
    """(``answer``, SQL), or ``clarify`` or ``refuse`` with none, for a question in plain words."""
    q = " ".join(re.findall(r"[a-z]+", question.lower()))
    if re.search(r"\b(name|birth|patient|address|phone|drop|delete|password|ignore|clinician|predict|why)\b", q):
        return "refuse", None
    words = {"count": r"\b(how many|count|number of)\b", "cancellation rate": r"\bcancel\w*", "mean readiness": r"\breadiness\b", "mean cost": r"\bcosts?\b"}
    found = [m for m, pattern in words.items() if re.search(pattern, q)]
    if len(found) > 1 and "count" in found:
        found.remove("count")
    if len(found) != 1:
        return "clarify", None
    by = re.search(r"\b(?:by|per|each)\b(.*)", q)
    group = ""
    if by:
        keys = [k for k in ("site", "service") if re.search(rf"\b{k}s?\b", by[1])]
        group = "by " + " and ".join(keys) if keys else ""
        if not keys:
            return "clarify", None
    needed = {"cancellation rate": "cancellation_proxy", "mean readiness": "readiness_days", "mean cost": "total_cost_cad"}.get(found[0])
    if any(c not in allowed for c in [*GROUPS[group], *([needed] if needed else [])]):
        return "refuse", None
    return "answer", template_sql(found[0], group)


def fixed_provider(statements: dict[str, str]) -> Callable[[str, Sequence[str]], tuple[str, str | None]]:
    """Answers listed questions with listed SQL and asks back for all others."""
    known = {" ".join(q.lower().split()): sql for q, sql in statements.items()}

    def provide(question: str, allowed: Sequence[str]) -> tuple[str, str | None]:
        sql = known.get(" ".join(question.lower().split()))
        return ("answer", sql) if sql else ("clarify", None)

    return provide


#: Ways to put questions into SQL, by name: each makes a function of (question, allowed columns).
PROVIDERS: dict[str, Callable[..., Callable[[str, Sequence[str]], tuple[str, str | None]]]] = {"template": lambda: question_sql, "fixed": fixed_provider}


def evaluation_summary(cases: DataFrame) -> DataFrame:
    """Refusal precision and recall, success rate, nearest-rank latency and cost from rows (expected, decision, correct, millis, cost)."""
    refused, should = F.col("decision") == "refuse", F.col("expected") == "refuse"
    out = cases.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(refused).alias("n_refused"), F.count_if(refused & should).alias("n_right"), F.count_if(should).alias("n_should"), F.avg(F.col("correct").cast("double")).alias("success"),
        F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY millis)").cast("long").alias("p99_millis"), F.sum("cost").alias("cost"),
    )
    return out.withColumn("refusal_precision", F.when(F.col("n_refused") > 0, F.col("n_right") / F.col("n_refused"))).withColumn("refusal_recall", F.when(F.col("n_should") > 0, F.col("n_right") / F.col("n_should")))

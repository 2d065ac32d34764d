"""User SQL over the tenant views: one read-only query, known relations and functions, bounded rows and time.

A statement is read twice, each time against closed lists: what is not on them is refused. The parsed tree, where comments, quotes and
brackets no longer matter, may hold only nodes and expressions of a plain query, known functions and names of one part, so that the
analysis meets no command, no file and no table function. The analysed tree then says what the names really stand for: all rows have to
come from the very views of the tenant that this session holds, or from the statement itself, whatever their names are, and all
expressions have to be of known classes. The session is the statement's own.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from auditlens.sources.store import Store, register_views

# --- fixed values: limits and the relations of a query ---
TABLES = {"v_claims", "v_findings", "doc_gaps"}
MAX_ROWS, TIMEOUT_S, MAX_QUESTION = 200, 5.0, 500
# --- end of fixed values ---

FUNCTIONS = set("""count sum avg mean min max min_by max_by median percentile percentile_approx stddev variance corr any_value first last bool_and bool_or count_if
 approx_count_distinct row_number rank dense_rank lag lead ntile abs ceil ceiling floor round power sqrt mod greatest least sign div coalesce nullif ifnull nvl
 if lower upper trim ltrim rtrim length substr substring left right concat concat_ws replace split instr locate like ilike rlike regexp_extract regexp_replace
 to_date date_add date_sub datediff date_format date_trunc year quarter month day dayofweek add_months months_between current_date to_timestamp
 try_cast between int bigint double decimal string date timestamp and or not in isnull isnotnull case when""".split())

#: Operators of a query, after analysis; a view stands for its rows and is not looked into.
_PLANS = set("""Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Join LateralJoin Union Intersect Except SubqueryAlias Window
 Pivot Unpivot Expand Tail OneRowRelation LocalRelation ResolvedInlineTable WithCTE CTERelationDef CTERelationRef View""".split())
#: What the parser makes of them before names are resolved.
_PARSED_PLANS = _PLANS - {"View"} | set("""WithWindowDefinition UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedHaving UnresolvedInlineTable
 UnresolvedRelation""".split())
_VALUES = set("""Literal Alias AttributeReference OuterReference SortOrder Cast And Or Not In InSet EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan
 GreaterThanOrEqual Between IsNull IsNotNull IsNaN Add Subtract Multiply Divide IntegralDivide Remainder Pmod UnaryMinus UnaryPositive CaseWhen If Coalesce
 Concat Like ILike RLike LikeAll LikeAny ScalarSubquery Exists ListQuery InSubquery LateralSubquery AggregateExpression WindowExpression WindowSpecDefinition
 SpecifiedWindowFrame UnspecifiedFrame UnboundedPreceding UnboundedFollowing CurrentRow RowFrame RangeFrame Floor Ceil RoundFloor RoundCeil
 DateAddInterval DateAddYMInterval TimeAdd TimestampAddInterval TimestampAddYMInterval SubtractDates SubtractTimestamps GetStructField GetArrayItem
 NamedExpression PrettyAttribute Grouping GroupingID NullIf Nvl Substring ToDate CreateNamedStruct Collate ResolvedCollation
 With CommonExpressionDef CommonExpressionRef TypedNullLiteral PivotFirst ExtractANSIIntervalDays""".split())
_PARSED_VALUES = _VALUES | set("""UnresolvedFunction UnresolvedAttribute UnresolvedStar UnresolvedAlias UnresolvedExtractValue UnresolvedRegex UnresolvedNamedLambdaVariable
 UnresolvedWindowExpression WindowSpecReference UnresolvedOrdinal UnresolvedSubqueryColumnAliases NamePlaceholder UnresolvedCollation MultiAlias
 Rollup Cube GroupingSets""".split())


def _kind(node: Any) -> str:
    return node.getClass().getName().rpartition(".")[2].rstrip("$").rpartition("$")[2]


def _all(found: Any) -> list[Any]:
    return [found.apply(k) for k in range(found.size())]


def _walk(node: Any, plan: bool = True) -> Iterator[tuple[str, Any, bool]]:
    """(class, node, whether it is an operator) of a tree: operators and their expressions, those of subqueries too. Views are leaves."""
    kind = _kind(node)
    yield kind, node, plan
    if kind == "View":
        return
    for child in _all(node.children()):
        yield from _walk(child, plan)
    if plan:
        if kind == "UnresolvedWith":
            for named in _all(node.cteRelations()):
                yield from _walk(named.productElement(1))
        for value in _all(node.expressions()):
            yield from _walk(value, False)
    elif kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        yield from _walk(node.plan())


def _name(parts: Any) -> str:
    return ".".join(str(p) for p in _all(parts)).lower()


def _check_parsed(tree: Any, functions: set[str]) -> None:
    nodes = list(_walk(tree))
    known = set(TABLES)
    for kind, n, _ in nodes:
        if kind == "UnresolvedWith":
            known |= {str(c.productElement(0)).lower() for c in _all(n.cteRelations())}
    for kind, n, plan in nodes:
        if kind not in _PARSED_PLANS if plan else kind not in _PARSED_VALUES and kind not in functions:
            raise ValueError(f"a query cannot hold {kind}")
        if kind == "UnresolvedRelation" and (n.multipartIdentifier().size() != 1 or _name(n.multipartIdentifier()) not in known):
            raise ValueError(f"{_name(n.multipartIdentifier())!r} is no table of this store")
        if kind == "UnresolvedFunction" and _name(n.nameParts()) not in FUNCTIONS:
            raise ValueError(f"the function {_name(n.nameParts())!r} is not allowed")


def _function_classes(spark: SparkSession) -> set[str]:
    """Classes of the allowed functions, as the session's registry of built-in ones has them."""
    catalog = spark._jsparkSession.sessionState().catalog()
    builtin = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    found = set()
    for name in FUNCTIONS:
        if catalog.isBuiltinFunction(builtin(name)):
            found.add(catalog.lookupFunctionInfo(builtin(name)).getClassName().rpartition(".")[2])
    return found


def _check_analysed(spark: SparkSession, tree: Any, functions: set[str]) -> None:
    state = spark._jsparkSession.sessionState()
    same = spark._jvm.java.lang.System.identityHashCode
    views = [state.catalog().getTempView(name) for name in sorted(TABLES)]
    own = {same(v.get().desc()) for v in views if v.isDefined()}
    try:
        plan = state.executePlan(tree, spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()).analyzed()
    except AnalysisException as exc:
        raise ValueError(f"the query cannot be resolved: {exc.getCondition()}") from exc
    for kind, n, is_plan in _walk(plan):
        if kind not in _PLANS if is_plan else kind not in _VALUES and kind not in functions:
            raise ValueError(f"a query cannot hold {kind}")
        if kind == "View" and same(n.desc()) not in own:
            raise ValueError("a query can only read the tables of this store")


def check_sql(spark: SparkSession, sql: str) -> str:
    """The statement, or an error saying what is wrong with it. `spark` is the session that it is going to run in, with its views."""
    text = sql.strip().rstrip(";").strip()
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as exc:
        raise ValueError("this is not one SQL query") from exc
    functions = _function_classes(spark)
    _check_parsed(tree, functions)
    _check_analysed(spark, tree, functions)
    return text


def check_question(question: str) -> str:
    if len(question) > MAX_QUESTION:
        raise ValueError(f"question is longer than {MAX_QUESTION} characters")
    return question


def guarded_sql(spark: SparkSession, store: Store, sql: str, tenant: str | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """Rows of a checked statement, in a session of its own; one row more than `max_rows` at most, which tells that there are more."""
    own = spark.newSession()
    register_views(own, store, tenant)
    return own.sql(check_sql(own, sql)).limit(max_rows + 1)


def bounded_run(df: DataFrame, timeout_s: float = TIMEOUT_S, max_rows: int = MAX_ROWS) -> pd.DataFrame:
    """Rows of a bounded result, or an error once the time is up; its jobs are then cancelled.

    `attrs["truncated"]` of what is returned tells whether rows were left out.
    """
    spark = df.sparkSession
    tag = f"adhoc-{uuid.uuid4().hex}"
    expired = threading.Event()

    def stop() -> None:
        expired.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout_s, stop)
    spark.addTag(tag)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        rows = df.limit(max_rows + 1).toPandas()
    except Exception as exc:
        if expired.is_set():
            raise TimeoutError(f"the query ran for more than {timeout_s:g} s and was stopped; ask a narrower question") from exc
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)
        spark.sparkContext.removeJobTag(tag)
    out = rows.head(max_rows)
    out.attrs["truncated"] = len(rows) > max_rows
    return out

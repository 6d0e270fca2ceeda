"""Foreign SQL over the curated views only: one reading statement of known parts, whose rows are limited.

The session's own parser gives the plan before analysis. All of it is walked: children, common table expressions,
and the plans inside expressions; what is on no list is refused. Names of views and limits are replaced in the text
at the places that the parser tells.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from ..plans.registry import query
from ..plans.views import LINES_SQL, ORDERS_SQL, v_order_lines, v_orders

#: The schema that foreign SQL may read, and rows that it gets at most.
SCHEMA, MOST_ROWS = "curated", 1000
VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"v_orders": v_orders, "v_order_lines": v_order_lines}
#: Parts of a plan that only read, and of its expressions.
NODES = frozenset("Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct SubqueryAlias UnresolvedWith Union Intersect Except Join LateralJoin UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedHaving OneRowRelation WithWindowDefinition UnresolvedInlineTable LocalRelation".split())
EXPRESSIONS = frozenset(
    """UnresolvedAttribute UnresolvedStar UnresolvedAlias MultiAlias Alias Literal Cast EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual And Or Not In InSubquery Between Like ILike LikeAll LikeAny NotLikeAll NotLikeAny
    IsNull IsNotNull Exists ScalarSubquery ListQuery LateralSubquery Add Subtract Multiply Divide Remainder UnaryMinus UnaryPositive CaseWhen If Coalesce UnresolvedFunction AttributeReference WindowExpression UnresolvedWindowExpression WindowSpecDefinition SpecifiedWindowFrame
    UnspecifiedFrame CurrentRow UnboundedPreceding UnboundedFollowing SortOrder UnresolvedOrdinal UnresolvedExtractValue CreateNamedStruct Concat""".split()
)
#: Groups of built-in functions that compute from their arguments alone; the others reach the session, the machine or its classes.
FUNCTIONS = frozenset("agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs date_funcs hash_funcs json_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs window_funcs".split())


class UnsafeSQLError(ValueError):
    """A statement was refused; the message says what in it."""


@dataclass(frozen=True)
class Safe:
    """The text with its limit put in, and whether the limit isn't the statement's own; views: (begin, end, name, whether it has an alias) of each in `sql`."""

    sql: str
    limit: int
    limit_applied: bool
    views: tuple[tuple[int, int, str, bool], ...]


def _each(seq: JavaObject) -> Iterator[JavaObject]:
    steps = seq.iterator()
    while steps.hasNext():
        yield steps.next()


def _kind(part: JavaObject) -> str:
    return part.getClass().getSimpleName().rstrip("$")


class _Walk:
    def __init__(self, spark: SparkSession, views: tuple[str, ...]) -> None:
        self.spark, self.views, self.found = spark, views, []
        self.holds_plan = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")
        self.registry = spark._jsparkSession.sessionState().functionRegistry()

    def plan(self, node: JavaObject, scope: frozenset[str]) -> None:
        kind = _kind(node)
        if kind not in NODES:
            raise UnsafeSQLError(f"{kind} is not allowed")
        if kind == "UnresolvedWith":
            for cte in _each(node.cteRelations()):
                name = cte._1().lower()
                self.plan(cte._2(), scope | {name} if node.allowRecursion() else scope)
                scope = scope | {name}
        if kind == "UnresolvedRelation":
            self.relation(node, scope, False)
        for expression in _each(node.expressions()):
            self.expression(expression, scope)
        for child in _each(node.children()):
            if _kind(child) == "UnresolvedRelation":
                self.relation(child, scope, kind == "SubqueryAlias")
            else:
                self.plan(child, scope)

    def relation(self, node: JavaObject, scope: frozenset[str], aliased: bool) -> None:
        name = [p.lower() for p in _each(node.multipartIdentifier())]
        if len(name) == 1 and name[0] in scope:
            return
        if len(name) != 2 or name[0] != SCHEMA or name[1] not in self.views:
            raise UnsafeSQLError(f"{'.'.join(name)} is no view of {SCHEMA}")
        at = node.origin()
        self.found.append((at.startIndex().get(), at.stopIndex().get() + 1, name[1], aliased))

    def expression(self, part: JavaObject, scope: frozenset[str]) -> None:
        kind = _kind(part)
        if kind not in EXPRESSIONS:
            raise UnsafeSQLError(f"{kind} is not allowed")
        if kind == "UnresolvedFunction":
            self.function([*_each(part.nameParts())])
        if self.holds_plan.isInstance(part):
            self.plan(part.plan(), scope)
        for child in _each(part.children()):
            self.expression(child, scope)

    def function(self, name: list[str]) -> None:
        info = self.registry.lookupFunction(self.spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name[-1])) if len(name) == 1 else None
        if info is None or info.isEmpty() or info.get().getGroup() not in FUNCTIONS:
            raise UnsafeSQLError(f"function {'.'.join(name)} is not allowed")


def _own_limit(plan: JavaObject) -> JavaObject | None:
    """The limit expression of the whole statement, below its common table expressions and an offset."""
    while _kind(plan) in ("UnresolvedWith", "Offset"):
        plan = plan.child()
    return plan.limitExpr() if _kind(plan) == "GlobalLimit" else None


def checked(spark: SparkSession, sql: str, cap: int = MOST_ROWS, views: tuple[str, ...] = tuple(VIEWS)) -> Safe:
    """The statement if nothing in it is refused. A limit over `cap`, or one that is no number, becomes `cap`; one that is missing is added."""
    if cap < 1:
        raise ValueError("cap must be positive")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise UnsafeSQLError("this is not one statement of SQL") from e
    walk = _Walk(spark, views)
    walk.plan(plan, frozenset())
    limit, own = _own_limit(plan), None
    if limit is not None and _kind(limit) == "Literal" and str(limit.value()).isdigit():
        own = int(str(limit.value()))
    parts = [(a, b, f"{SCHEMA}.{name}", (name, aliased)) for a, b, name, aliased in walk.found]
    if limit is not None and (own is None or own > cap):
        at = limit.origin()
        parts.append((at.startIndex().get(), at.stopIndex().get() + 1, str(cap), None))
    text, end, places = "", 0, []
    for a, b, by, name in sorted(parts, key=lambda p: p[0]):
        text += sql[end:a] + by
        if name:
            places.append((len(text) - len(by), len(text), *name))
        end = b
    text += sql[end:]
    if limit is None:
        text = f"{text.rstrip().rstrip(';')}\nLIMIT {cap}"
    return Safe(text, own if own is not None and own <= cap else cap, own is None or own > cap, tuple(places))


def guarded(spark: SparkSession, sf_dir: str, sql: str, cap: int = MOST_ROWS) -> DataFrame:
    """The rows of an allowed statement over the curated views; all that is refused raises UnsafeSQLError before anything runs."""
    safe = checked(spark, sql, cap)
    names = {name: f"lodestone_{uuid.uuid4().hex}" for _, _, name, _ in safe.views}
    text, end = "", 0
    for a, b, name, aliased in safe.views:
        # a view keeps its name in the statement unless it is given another
        text += safe.sql[end:a] + names[name] + ("" if aliased else f" {name}")
        end = b
    text += safe.sql[end:]
    try:
        for name, view in names.items():
            VIEWS[name](spark, sf_dir).createOrReplaceTempView(view)
        return spark.sql(text)
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)


_BY_COUNTRY = "SELECT customer_country, count(*) AS orders, round(avg(days_to_ship), 6) AS days FROM curated.v_orders WHERE order_status IN ('F', 'O') GROUP BY customer_country"
_LARGE = "WITH big AS (SELECT order_id, line_no, quantity FROM {0}v_order_lines WHERE quantity > (SELECT avg(quantity) FROM {0}v_order_lines)) SELECT b.order_id, b.line_no, o.customer_id FROM big b JOIN {0}v_orders o ON o.order_id = b.order_id ORDER BY b.order_id, b.line_no LIMIT {1}"


@query("sql_guarded", f"WITH {ORDERS_SQL} {_BY_COUNTRY.replace('curated.', '')} LIMIT {MOST_ROWS}")
def sql_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement without a limit, as it comes from outside."""
    return guarded(spark, sf_dir, _BY_COUNTRY)


@query("sql_guarded_limit", f"WITH {ORDERS_SQL}, {LINES_SQL}, {_LARGE.format('', MOST_ROWS).removeprefix('WITH ')}")
def sql_guarded_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit over the cap is lowered, with common table expressions and a subquery."""
    return guarded(spark, sf_dir, _LARGE.format("curated.", 5000))

"""What comes back from connectors: shaped JSON, allowed arguments, rendered paths, described schemas."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.views import v_order_lines, v_orders
from ..session import table

#: Keys under which responses wrap their list, items and characters kept.
ENVELOPES = ("data", "items", "results", "records")
MAX_ITEMS, MAX_CHARS, MAX_VALUE = 25, 20_000, 200


def allowed(arguments: Column, declared: tuple[str, ...]) -> Column:
    """A map of only the declared keys."""
    return F.map_filter(arguments, lambda k, _: k.isin(*declared))


@query("map_allowlist", "SELECT event_id, 'k=' || json_extract_string(props, '$.k') || ',q=' || (event_id % 3) AS kept, 2 AS dropped FROM events")
def map_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared arguments by key, and how many undeclared ones were dropped."""
    given = F.from_json(F.concat(F.lit('{"labels": "x", "q": "'), (F.col("event_id") % 3).cast("string"), F.lit('", "__proto__": "y", '), F.expr("substr(props, 2)")), "map<string,string>")
    rows = table(spark, sf_dir, "events").select("event_id", given.alias("given"))
    kept = allowed(F.col("given"), ("k", "q"))
    entries = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rows.select("event_id", F.array_join(entries, ",").alias("kept"), (F.size("given") - F.size(kept)).alias("dropped"))


def json_members(text: Column) -> Column:
    """The members of a JSON object with their types, or null for what is none."""
    parsed = F.try_parse_json(text)
    return F.when(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), parsed.cast("map<string,variant>"))


def with_member(text: Column, key: str, value: Column) -> Column:
    """JSON text with a member put in, in place of one of that name; all others keep their values and types. Null where the text is no object."""
    others = F.map_filter(json_members(text), lambda k, _: k != key)
    return F.to_json(F.map_concat(others, F.create_map(F.lit(key), value.cast("variant"))))


@query("json_set", "SELECT event_id, CAST(json_merge_patch(props, json_object('_created_id', 'c' || event_id)) AS VARCHAR) AS changed FROM events")
def json_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key put into stored JSON, the others as they were."""
    changed = with_member(F.col("props"), "_created_id", F.concat(F.lit("c"), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", changed.alias("changed"))


#: What stands in place of the items that are left out.
_NOTICE = ("Only the first {kept} of ", " items of ", " are listed; the same request gives the same ones, so ask for less, by a filter or an identifier.")


def shaped(responses: DataFrame, id_: str, body: str, request: str) -> DataFrame:
    """Responses as rows: the id, item from 0, place of the key in its item, key, value; and one notice where items were left out.

    A list is taken as it is, or from the first envelope key that holds one; any other object is one item, and
    another value one item with the key `value`. MAX_ITEMS items are kept. Nested values are compact JSON of
    MAX_VALUE characters at most, missing ones empty; a string is as it is, whatever it begins with. What is no JSON is one item `body` of MAX_CHARS characters.
    The notice stands behind the last item. Parsing and rendering stay in the JVM.
    """
    raw = F.trim(F.col(body))
    document = F.try_parse_json(raw)
    lists = [F.when(F.startswith(raw, F.lit("[")), raw), *[F.get_json_object(raw, f"$.{k}") for k in ENVELOPES]]
    found = F.coalesce(*[F.when(F.startswith(t, F.lit("[")), t) for t in lists])
    rows = responses.select(F.col(id_), F.col(body).alias("body_"), F.col(request).alias("request_"), document.isNotNull().alias("json_"), raw.alias("raw_"), F.from_json(found, "array<string>").alias("list_"))
    one = F.when(F.startswith("raw_", F.lit("{")), F.array("raw_")).otherwise(F.array(F.to_json(F.struct(F.regexp_replace("raw_", '^"|"$', "").alias("value")))))
    items = F.when(~F.coalesce("json_", F.lit(False)), F.array(F.to_json(F.struct(F.substring("body_", 1, MAX_CHARS).alias("body"))))).otherwise(F.coalesce("list_", one))
    rows = rows.select(id_, "request_", items.alias("items_"))
    objects = F.transform(F.slice("items_", 1, MAX_ITEMS), lambda t: F.when(F.startswith(t, F.lit("{")), F.struct(F.from_json(t, "map<string,string>").alias("texts"), json_members(t).alias("members"))).otherwise(F.struct(F.create_map(F.lit("value"), t).alias("texts"), F.lit(None).cast("map<string,variant>").alias("members"))))
    cell = lambda m, i: lambda e, k: F.struct(i.alias("item"), k.alias("place"), e["key"].alias("key"), rendered(e["value"], F.try_element_at(m["members"], e["key"])).alias("value"))
    cells = F.flatten(F.transform(objects, lambda m, i: F.transform(F.map_entries(m["texts"]), cell(m, i))))
    total = F.size("items_")
    notice = F.concat(F.lit(_NOTICE[0].format(kept=MAX_ITEMS)), total.cast("string"), F.lit(_NOTICE[1]), F.col("request_"), F.lit(_NOTICE[2]))
    last = F.when(total > MAX_ITEMS, F.array(F.struct(F.lit(MAX_ITEMS).alias("item"), F.lit(0).alias("place"), F.lit("").alias("key"), notice.alias("value")))).otherwise(F.slice(cells, 1, 0))
    return rows.select(id_, F.explode(F.concat(cells, last)).alias("c")).select(id_, "c.*")


def rendered(value: Column, member: Column) -> Column:
    """A member's text; objects and lists, as their type says, are cut."""
    nested = F.coalesce(F.rlike(F.schema_of_variant(member), F.lit("^(OBJECT|ARRAY)")), F.lit(False))
    return F.when(nested & (F.length(value) > MAX_VALUE), F.concat(F.substring(value, 1, MAX_VALUE), F.lit("…"))).otherwise(F.coalesce(value, F.lit("")))


_SHAPE_SQL = f"""WITH o AS (SELECT o_custkey // 10 AS id, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey // 10 ORDER BY o_orderkey) - 1 AS item, count(*) OVER (PARTITION BY o_custkey // 10) AS total FROM orders)
 SELECT id, CAST(item AS INTEGER) AS item, 0 AS place, 'key' AS key, CAST(o_orderkey AS VARCHAR) AS value FROM o WHERE item < {MAX_ITEMS}
 UNION ALL SELECT id, CAST(item AS INTEGER), 1, 'more', '{{"status":"' || o_orderstatus || '"}}' FROM o WHERE item < {MAX_ITEMS}
 UNION ALL SELECT DISTINCT id, {MAX_ITEMS}, 0, '', '{_NOTICE[0].format(kept=MAX_ITEMS)}' || total || '{_NOTICE[1]}GET /orders{_NOTICE[2]}' FROM o WHERE total > {MAX_ITEMS}"""


@query("json_shape", _SHAPE_SQL)
def json_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses made from orders, in an envelope, and shaped again; a response holds the orders of ten customers."""
    item = F.struct("o_orderkey", F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderstatus").alias("status")).alias("more")).alias("v"))
    pages = table(spark, sf_dir, "orders").groupBy(F.expr("o_custkey div 10").alias("id")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias("items"))
    bodies = pages.select("id", F.to_json(F.struct(F.lit(1).alias("page"), "items")).alias("body"), F.lit("GET /orders").alias("request"))
    return shaped(bodies, "id", "body", "request")


#: What an encoded segment of a path may hold besides letters, digits and escapes.
_SEGMENT = re.compile("(?!.*[.][.])[^/]*")


def render_path(path: str, declared: tuple[str, ...], values: dict[str, str]) -> str:
    """A path template with its declared placeholders filled, each by one encoded segment; other braces stay."""
    segments = {name: str(values[name]) for name in declared if name in values}
    bad = [name for name in declared if not _SEGMENT.fullmatch(segments.get(name, "/"))]
    if bad:
        raise ValueError(f"path parameter {bad[0]!r} is missing or is no single segment")
    return re.sub(r"\{(\w+)\}", lambda m: quote(segments[m[1]], safe="~!$&'()*+,;=:@") if m[1] in segments else m[0], path)


_VIEW_TABLES = {"v_orders": "orders", "v_order_lines": "lineitem"}


@query("describe_schema", "SELECT 'v_orders' AS view, count(*) AS n, 8 AS columns FROM orders UNION ALL SELECT 'v_order_lines', count(*), 7 FROM lineitem")
def describe_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated views: how many rows and columns each has. Rows are counted where keys are unique, without the joins."""
    views = {"v_orders": v_orders(spark, sf_dir), "v_order_lines": v_order_lines(spark, sf_dir)}
    counts = [table(spark, sf_dir, _VIEW_TABLES[view]).agg(F.count(F.lit(1)).alias("n")).select(F.lit(view).alias("view"), "n", F.lit(len(df.columns)).alias("columns")) for view, df in views.items()]
    return counts[0].unionAll(counts[1])


def view_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view, place, name and type of every column of the curated views; metadata only, nothing is read."""
    views = {"v_orders": v_orders(spark, sf_dir), "v_order_lines": v_order_lines(spark, sf_dir)}
    rows = [(view, k, f.name, f.dataType.simpleString()) for view, df in views.items() for k, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "view string, place int, name string, type string")


def capped(rows: DataFrame, order: list, cap: int) -> DataFrame:
    """The first `cap` rows in an order, and in each whether there were more: one row more is fetched to tell."""
    marked = rows.orderBy(*order).limit(cap + 1)
    # cap + 1 rows at most
    place = F.row_number().over(Window.orderBy(*order))
    total = F.count(F.lit(1)).over(Window.partitionBy())
    return marked.select("*", place.alias("place_"), (total > cap).alias("truncated")).where(F.col("place_") <= cap).drop("place_")


@query("limit_cap", "SELECT o_orderkey, (SELECT count(*) > 1000 FROM orders) AS truncated FROM orders ORDER BY o_orderkey LIMIT 1000")
def limit_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capped(table(spark, sf_dir, "orders").select("o_orderkey"), [F.col("o_orderkey")], 1000)

"""The REST source over recorded responses, shaped as rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import shared_dir, table
from ..sources.rest import Endpoint, RestSource, asked, record
from .connectors import _NOTICE, MAX_ITEMS, shaped

CUSTOMERS = Endpoint("customers", "/nations/{nation}/customers", ("nation",), ("segment",))
#: Items that the recorded interface gives in one response.
PAGE = 40

_REST_SQL = f"""WITH c AS (SELECT c_nationkey AS no, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS item, count(*) OVER (PARTITION BY c_nationkey) AS total FROM customer WHERE c_mktsegment = 'BUILDING'),
 n AS (SELECT CAST(no AS INTEGER) AS no, CAST(item AS INTEGER) AS item, c_custkey, c_name, total FROM c WHERE item < {MAX_ITEMS})
 SELECT no, item, 0 AS place, 'key' AS key, CAST(c_custkey AS VARCHAR) AS value FROM n UNION ALL SELECT no, item, 1, 'name', c_name FROM n
 UNION ALL SELECT DISTINCT no, {MAX_ITEMS}, 0, '', '{_NOTICE[0].format(kept=MAX_ITEMS)}' || least(total, {PAGE}) || '{_NOTICE[1]}customers /nations/' || no || '/customers?segment=BUILDING{_NOTICE[2]}' FROM n WHERE total > {MAX_ITEMS}"""


@query("rest_rows", _REST_SQL)
def rest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request a nation, for its customers of a segment; an argument that isn't declared is dropped."""
    folder = f"{shared_dir(spark)}/recorded-{uuid.uuid4()}"
    rows = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").withColumn("item", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))).where(F.col("item") <= PAGE)
    item = F.struct("item", F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).alias("v"))
    pages = rows.groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias("items"))  # a page each
    request = F.concat(F.lit("/nations/"), F.col("c_nationkey").cast("string"), F.lit("/customers?segment=BUILDING"))
    record(pages.select(request.alias("request"), F.to_json(F.struct("items")).alias("body")), folder)
    spark.dataSource.register(RestSource)
    nations = [r["n_nationkey"] for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # requests are configuration
    options = asked([CUSTOMERS], [("customers", {"nation": str(n), "segment": "BUILDING", "debug": "1"}) for n in nations], folder)
    got = spark.read.format("lodestone_rest").options(**options).load().where("error IS NULL")
    return shaped(got, "no", "body", "request")

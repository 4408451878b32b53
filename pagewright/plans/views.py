"""Views that the queries start from, once for Spark and once as DuckDB's SQL. They are derived from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.session import table

LABELS = ["table", "text", "paragraph_title", "image", "footer", "formula"]


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Detections: a box per order line, a page per order."""
    line = table(spark, d, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    seq = (F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)) - 1).cast("bigint")
    x1, y1 = (F.col("l_partkey") % 200).cast("double"), ((F.col("l_suppkey") * 37) % 150).cast("double")
    return line.select(
        F.col("l_orderkey").alias("page"), seq.alias("seq"), x1.alias("x1"), y1.alias("y1"),
        (x1 + 40 + 4 * F.col("l_quantity").cast("double")).alias("x2"), (y1 + 20 + 12 * (F.col("l_partkey") % 5)).cast("double").alias("y2"),
        F.element_at(F.array(*map(F.lit, LABELS)), (F.col("l_linenumber") % 6 + 1).cast("int")).alias("label"),
        (F.lit(0.3) + 6 * F.col("l_discount").cast("double")).alias("score"), (F.col("l_linenumber") % 3).cast("int").alias("origin"),
    )


BOXES = f"""boxes AS (SELECT l_orderkey AS page,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS seq,
 CAST(l_partkey % 200 AS DOUBLE) AS x1, CAST((l_suppkey * 37) % 150 AS DOUBLE) AS y1,
 CAST(l_partkey % 200 AS DOUBLE) + 40 + 4 * CAST(l_quantity AS DOUBLE) AS x2,
 CAST((l_suppkey * 37) % 150 AS DOUBLE) + 20 + 12 * (l_partkey % 5) AS y2,
 [{", ".join(f"'{x}'" for x in LABELS)}][CAST(l_linenumber % 6 + 1 AS INTEGER)] AS label,
 0.3 + 6 * CAST(l_discount AS DOUBLE) AS score, CAST(l_linenumber % 3 AS INTEGER) AS origin FROM lineitem)"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every block once: the last delivery of its id."""
    b = table(spark, d, "blocks")
    names = [c for c in b.columns if c != "block_id"]
    last = F.max_by(F.struct(*names), F.col("ingested_at")).alias("b")
    return b.groupBy("block_id").agg(last).select("block_id", "b.*")


BLOCKS = "bl AS (SELECT * FROM blocks QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY ingested_at DESC) = 1)"


def results(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "page_results")
    names = [c for c in r.columns if c != "result_id"]
    return r.groupBy("result_id").agg(F.max_by(F.struct(*names), F.col("arrived_at")).alias("r")).select("result_id", "r.*")


RESULTS = "pr AS (SELECT * FROM page_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY arrived_at DESC) = 1)"


def regions(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).select("result_id", "book_id", "page_index", "width", "height", F.posexplode("regions").alias("seq", "r"))
    rect = {c: F.col("r.rect")[i].cast("double").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))}
    return r.select("result_id", "book_id", "page_index", "width", "height", F.col("seq").cast("bigint").alias("seq"), F.col("r.label").alias("label"), F.col("r.score").alias("score"), *rect.values())


REGIONS = RESULTS + """, rg AS (SELECT result_id, book_id, page_index, width, height, CAST(i - 1 AS BIGINT) AS seq, regions[i].label AS label, regions[i].score AS score,
 CAST(regions[i].rect[1] AS DOUBLE) AS x1, CAST(regions[i].rect[2] AS DOUBLE) AS y1, CAST(regions[i].rect[3] AS DOUBLE) AS x2, CAST(regions[i].rect[4] AS DOUBLE) AS y2
 FROM pr, unnest(range(1, len(regions) + 1)) AS u(i))"""


def service_pages(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "service_pages")
    names = [c for c in s.columns if c != "service_page_id"]
    return s.groupBy("service_page_id").agg(F.max_by(F.struct(*names), F.col("received_at")).alias("s")).select("service_page_id", "s.*")


SERVICE = "sp AS (SELECT * FROM service_pages QUALIFY row_number() OVER (PARTITION BY service_page_id ORDER BY received_at DESC) = 1)"


def books(spark: SparkSession, d: str) -> DataFrame:
    """Every book once: of equal ids the first name in order counts."""
    return table(spark, d, "books").groupBy("id").agg(F.min(F.struct("name", "bind", "belong", "status", "added_at")).alias("b")).select("id", "b.*")

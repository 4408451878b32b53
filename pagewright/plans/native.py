"""Queries of which SQL has no twin: difflib, ink masks, the talk with a model, streams. Tests hold them against brute force."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import native as N
from pagewright.operators import protocol
from pagewright.operators import translation as X
from pagewright.session import shared_folder, table

from .documents import _bp
from .texts import neighbours
from .views import blocks, regions


def text_ratio_native(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(spark, d).select("a_block_id", "b_block_id", N.ratio(F.col("a_norm"), F.col("b_norm")).alias("ratio"))


def page_regions_resolve(spark: SparkSession, d: str) -> DataFrame:
    text = blocks(spark, d).select("book_id", "page_index", F.col("block_pos").cast("bigint").alias("seq"), F.col("content").alias("text"))
    r = regions(spark, d).join(text, ["book_id", "page_index", "seq"], "left")
    return N.resolve_pages(r.select("result_id", "seq", "label", "score", "x1", "y1", "x2", "y2", "text"), "result_id")


def _rasters(spark: SparkSession, d: str) -> DataFrame:
    """A page a row. Few bytes are much work here, so the pages are dealt out to a number of tasks that isn't lowered by size."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    r = regions(spark, d).repartition(tasks, "result_id")
    return r.groupBy("result_id", "width", "height").agg(F.array_sort(F.collect_list(F.struct("seq", F.array("x1", "y1", "x2", "y2").alias("box")))).alias("l")).select("result_id", "width", "height", F.col("l.box").alias("boxes"))


def ink_trim(spark: SparkSession, d: str) -> DataFrame:
    """Regions drawn in to the ink of a page hatched inside them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                ink = N.draw_bands((r.height, r.width), [[x[0] + 9, x[1] + 9, x[2] - 9, x[3] - 9] for x in r.boxes])
                out += [(r.result_id, n, *x) for n, x in enumerate(N.trim_to_ink([list(map(float, x)) for x in r.boxes], ink))]
            yield pd.DataFrame(out, columns=["result_id", "seq", "x1", "y1", "x2", "y2"])

    return _rasters(spark, d).mapInPandas(run, "result_id bigint, seq int, x1 double, y1 double, x2 double, y2 double")


def text_lines_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines found in a page hatched where its regions are, 30 pixels high at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                ink = N.draw_bands((r.height, r.width), [[x[0], x[1], x[2], min(x[3], x[1] + 30)] for x in r.boxes])
                out += [(r.result_id, n, *x) for n, x in enumerate(N.text_lines(ink))]
            yield pd.DataFrame(out, columns=["result_id", "line", "x1", "y1", "x2", "y2"])

    return _rasters(spark, d).mapInPandas(run, "result_id bigint, line int, x1 int, y1 int, x2 int, y2 int")


def stub_model(asked: dict[str, str], context: list[str] | None, n: int) -> str:
    """Answers in capitals; asks for context where a text starts in lower case, drops an item in its first answer to five."""
    if context is None and any(t[:1].islower() for t in asked.values()):
        return json.dumps({"need_context": "before"})
    items = [{"index": i, "A": t if t.startswith('{"table"') else t.upper()} for i, t in asked.items()]
    if context:
        return json.dumps({"result": items, "external_index": 0, "external": context[0].upper()})
    return "```json\n" + json.dumps({"result": items[:-1] if n == 1 and len(items) == 5 else items}) + "\n```"


def context_protocol(spark: SparkSession, d: str) -> DataFrame:
    b, p = _bp(spark, d)
    r = X.requests(b, p).groupBy("book_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("block_pos", "index", "q", (F.col("type") == "table").alias("is_table")))).alias("l"))
    for side in ("before", "after"):
        c = X.context(b, p, side).groupBy("book_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("block_pos", "c"))).alias(side))
        r = r.join(c.select("book_id", "page_index", F.col(f"{side}.c").alias(side)), ["book_id", "page_index"], "left")
    return protocol.run_pages(r.select("book_id", "page_index", F.col("l.index").alias("asked"), F.col("l.q").alias("texts"), F.col("l.is_table").alias("tables"), "before", "after"), stub_model)


def strikes_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of jobs, run to its end: every book's and kind's strikes after its last job."""
    from pagewright.streaming import jobs

    schema = table(spark, d, "events").schema
    where = f"{shared_folder(spark)}/strikes-{uuid.uuid4().hex}"
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    j = e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("book_id"), F.when(F.col("event_id") % 2 == 0, "ocr").otherwise("translate").alias("kind"), (F.col("event_type") != "error").alias("ok"))

    def keep(part: DataFrame, n: int) -> None:  # written anew if the micro-batch is run again
        part.write.mode("overwrite").parquet(f"{where}/out/batch={n}")

    q = jobs.strikes(j).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{where}/out").groupBy("book_id", "kind").agg(F.max_by("strikes", "seq").alias("strikes"))


QUERIES = {f.__name__: f for f in (text_ratio_native, page_regions_resolve, ink_trim, text_lines_scan, context_protocol, strikes_stream)}
SQL = {
    "strikes_stream": """WITH j AS (SELECT event_id, CAST(user_id AS VARCHAR) AS book_id, CASE WHEN event_id % 2 = 0 THEN 'ocr' ELSE 'translate' END AS kind, event_type <> 'error' AS ok FROM events),
l AS (SELECT book_id, kind, max(CASE WHEN ok THEN event_id END) AS last FROM j GROUP BY 1, 2)
SELECT book_id, kind, CAST(count(*) FILTER (NOT ok AND event_id > coalesce(last, -1)) AS INTEGER) AS strikes FROM j JOIN l USING (book_id, kind) GROUP BY 1, 2""",
}

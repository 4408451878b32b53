"""The relational core of translating a library: what to send, with which context, and what comes back.

blocks: (book_id, page_index, block_pos, type, content, translation); pages: (book_id, page_index, finished, translated).
A null `translated` is false. A block to translate has a type that may be, text, and no translation yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import tables

CANDIDATES = 3
PAGE = ["book_id", "page_index"]


def page_work(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """For each page: does it wait for recognition, for translation, for tables of an already translated page?"""
    pending = T.is_translatable(F.col("type"), F.col("content")) & F.col("translation").isNull()
    sums = blocks.groupBy(*PAGE).agg(F.count_if(pending).alias("pending"), F.count_if(pending & (F.col("type") == "table")).alias("tables"))
    done = F.coalesce("translated", F.lit(False))
    j = pages.join(sums, PAGE, "left").fillna(0, ["pending", "tables"])
    return j.select(*PAGE, (~F.col("finished")).alias("needs_ocr"), (F.col("finished") & ~done).alias("needs_translation"), (F.col("finished") & done & (F.col("tables") > 0)).alias("needs_tables"), "pending")


def requests(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks to send, numbered from 0 within their page; on a translated page only tables are sent again."""
    j = blocks.join(pages.filter("finished").select(*PAGE, F.coalesce("translated", F.lit(False)).alias("done")), PAGE)
    is_table = F.col("type") == "table"
    j = j.filter(T.is_translatable(F.col("type"), F.col("content")) & F.col("translation").isNull() & (~F.col("done") | is_table))
    j = j.withColumn("q", F.when(is_table, tables.payload(tables.parse_any(F.when(is_table, F.col("content"))))).otherwise(F.col("content"))).filter("q is not null")
    n = F.row_number().over(W.partitionBy(*PAGE).orderBy("block_pos")) - 1
    return j.select(*PAGE, n.cast("string").alias("index"), "block_pos", "type", "q")


def context(blocks: DataFrame, pages: DataFrame, direction: str, most: int = CANDIDATES) -> DataFrame:
    """For each page its neighbour's candidates: the last of the page before, the first of the page after."""
    order = F.desc("block_pos") if direction == "before" else F.asc("block_pos")
    fine = blocks.filter(T.is_translatable(F.col("type"), F.col("content")))
    near = fine.withColumn("rn", F.row_number().over(W.partitionBy(*PAGE).orderBy(order))).filter(F.col("rn") <= most)
    place = F.row_number().over(W.partitionBy(*PAGE).orderBy("block_pos")) - 1
    shown = F.coalesce(tables.payload(tables.parse_any(F.when(F.col("type") == "table", F.col("content")))), F.col("content"))
    near = near.select("book_id", F.col("page_index").alias("neighbour"), place.cast("string").alias("index"), shown.alias("c"), "block_pos")
    wanted = pages.select("book_id", "page_index", (F.col("page_index") + (-1 if direction == "before" else 1)).alias("neighbour"))
    return wanted.join(near, ["book_id", "neighbour"])


def phases(pages: DataFrame) -> DataFrame:
    """Two phases in which no two neighbours of the asked pages are worked on at once: by position, not by page number."""
    p = pages.select(*PAGE).distinct()
    return p.select(*PAGE, ((F.row_number().over(W.partitionBy("book_id").orderBy("page_index")) - 1) % 2).alias("phase"))


REPLY = "struct<result:array<struct<index:string,A:string,content:string>>,need_context:string>"


def parse_replies(replies: DataFrame) -> DataFrame:
    """replies(book_id, page_index, raw) -> (.., index, value, need_context, ok): one row an answered item; a reply that is no
    JSON, or has an item without an index, is one row with ok = false."""
    j = replies.withColumn("r", F.from_json(T.extract_json(F.col("raw")), REPLY))
    void = F.col("r").isNull() | F.coalesce(F.exists("r.result", lambda x: x["index"].isNull()), F.lit(False))
    asked = F.when(F.col("r.need_context").isin("before", "after"), F.col("r.need_context"))
    j = j.withColumn("items", F.when(~void, F.col("r.result"))).withColumn("ok", ~void).withColumn("need_context", asked)
    return j.select(*PAGE, "ok", "need_context", F.explode_outer("items").alias("i")).select(*PAGE, "ok", "need_context", F.col("i.index").alias("index"), F.coalesce("i.A", "i.content").alias("value"))


def validate(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Pages by whether the reply answers every request once and nothing else, tables in the shape that was asked."""
    got = items.filter("ok and index is not null").groupBy(*PAGE, "index").agg(F.count("*").alias("times"), F.first("value").alias("value"))
    j = requests.select(*PAGE, "index", "type", "q", F.lit(1).alias("asked")).join(got, [*PAGE, "index"], "full_outer")
    misshapen = (F.col("type") == "table") & F.col("value").isNotNull() & tables.fitting_matrix(F.col("value"), F.col("q")).isNull()
    sums = {"missing": F.col("times").isNull(), "unasked": F.col("asked").isNull(), "repeated": F.col("times") > 1, "misshapen": misshapen}
    by = j.groupBy(*PAGE).agg(*(F.count_if(x).alias(n) for n, x in sums.items()))
    return by.withColumn("valid", sum((F.col(n) for n in sums), F.lit(0)) == 0)


def apply_values(blocks: DataFrame, requests: DataFrame, items: DataFrame) -> DataFrame:
    """Blocks with the values of valid replies; a page whose reply isn't valid stays as it is. A null value leaves the block as
    it is, but a table without one gets its source. Tables keep the grid that was asked (`grid`, made of the content's)."""
    valid = validate(requests, items).filter("valid").select(*PAGE)
    done = requests.join(valid, PAGE, "left_semi").join(items.filter("ok").select(*PAGE, "index", "value"), [*PAGE, "index"])
    is_table = F.col("type") == "table"
    value = F.when(is_table, F.coalesce(tables.fitting_matrix(F.col("value"), F.col("q")), F.get_json_object("q", "$.table"))).otherwise(F.col("value"))
    done = done.select(*PAGE, "block_pos", value.alias("new"), is_table.alias("gridded"))
    out = blocks.join(done, [*PAGE, "block_pos"], "left").withColumn("translation", F.coalesce("new", "translation"))
    return out.withColumn("grid", tables.parse_any(F.when(F.col("gridded"), F.col("content")))).drop("new", "gridded")


def bypass(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Content taken for translation on pages that are recognised and not translated; tables keep their source matrix."""
    open_pages = pages.filter("finished and not coalesce(translated, false)").select(*PAGE, F.lit(True).alias("open"))
    own = F.when(F.col("type") == "table", tables.source_matrix(tables.parse_any(F.when(F.col("type") == "table", F.col("content"))))).otherwise(F.col("content"))
    take = F.col("open").isNotNull() & F.col("translation").isNull() & T.is_translatable(F.col("type"), F.col("content"))
    return blocks.join(open_pages, PAGE, "left").withColumn("translation", F.when(take, own).otherwise(F.col("translation"))).drop("open")

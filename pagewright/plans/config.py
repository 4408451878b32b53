"""Queries on settings, prompts, model requests and inherited attributes, over relations made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import catalog as C
from pagewright.operators import config as K
from pagewright.session import table
from pagewright.sources.requests import select_document

from .views import BLOCKS, REGIONS, SERVICE, blocks, regions, service_pages


def page_frames(spark: SparkSession, d: str) -> DataFrame:
    """A tree of document objects: parts, each under the tenth of its number; some have boxes, some a rotation."""
    o = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") >= 10, F.floor(F.col("p_partkey") / 10).cast("bigint")).alias("parent"),
        F.when(F.col("p_partkey") % 7 == 0, F.col("p_size")).alias("crop"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * 2).alias("media"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") * 90 - 900).alias("rotate"),
    ).dropDuplicates(["id"])
    return K.page_frames(o).select("id", F.col("frame").cast("bigint").alias("frame"), F.col("rotation").cast("bigint").alias("rotation"))


def prompts_by_page(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_info")
    template = F.when(F.col("page_index") % 2 == 0, "Translate into {{target_language}}.").otherwise("Translate.")
    return p.select("book_id", "page_index", K.prompt(template, F.when(F.col("page_index") % 5 == 0, " ").otherwise(F.col("target_lang"))).alias("prompt"))


def settings_merge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    user = F.concat(F.lit('{"batch":'), F.when(F.col("event_id") % 3 == 0, F.lit('"many"')).otherwise((F.col("event_id") % 40).cast("string")), F.when(F.col("event_id") % 2 == 0, F.lit(',"auto":false')).otherwise(F.lit("")), F.lit("}"))
    return e.select("event_id", K.setting(user, "batch", "int", F.lit(16)).alias("batch"), K.setting(user, "auto", "boolean", F.lit(True)).alias("auto"))


def model_payloads(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    n = F.col("s_suppkey")
    p = K.model_payload(n % 2 == 0, F.col("s_name"), F.when(n % 3 == 0, " ").otherwise("key"), F.lit("m "))
    return s.select("s_suppkey", p.isNotNull().alias("sent"), p["model"].alias("model"))


def task_prompts(spark: SparkSession, d: str) -> DataFrame:
    p = K.task_prompt(F.col("label"), {"table": "Table Recognition:", "formula": "Formula Recognition:", "chart": "Chart Recognition:", "_default": "OCR:"})
    return regions(spark, d).groupBy("label", p.alias("prompt")).agg(F.count("*").alias("regions"))


def region_json(spark: SparkSession, d: str) -> DataFrame:
    r = regions(spark, d)
    rect = F.array(*(F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")))
    return r.select("result_id", "seq", F.to_json(F.struct("label", F.round("score", 4).alias("score"), rect.alias("rect"))).alias("json"))


def request_bodies(spark: SparkSession, d: str) -> DataFrame:
    """A question for each title in each of the protocols, and what is read back from an answer in that shape."""
    b = blocks(spark, d).filter("type = 'paragraph_title'")
    protocol = F.element_at(F.array(*map(F.lit, C.PROTOCOLS)), (F.col("block_id") % 3 + 1).cast("int"))
    body = K.request_body(protocol, F.lit("m"), F.lit("s"), F.col("content"), F.lit(8192))
    text = F.coalesce(F.get_json_object(body, "$.messages[1].content"), F.get_json_object(body, "$.messages[0].content"), F.get_json_object(body, "$.input[0].content"))
    shape = lambda pre, post: F.concat(F.lit(pre), F.to_json(F.struct(F.col("content").alias("x"))), F.lit(post))
    answer = F.when(protocol == C.PROTOCOLS[0], shape('{"choices":[{"message":', "}]}")).when(protocol == C.PROTOCOLS[1], shape('{"output":[{"content":[', "]}]}")).otherwise(shape('{"content":[', "]}"))
    answer = F.replace(answer, F.lit('"x":'), F.when(protocol == C.PROTOCOLS[0], F.lit('"content":')).otherwise(F.lit('"text":')))
    return b.select("block_id", protocol.alias("protocol"), (text == F.col("content")).alias("asked"), K.completion(protocol, answer).alias("answer"))


def document_payloads(spark: SparkSession, d: str) -> DataFrame:
    s = service_pages(spark, d)
    i = F.col("service_page_id") % 5
    kind = F.when(i == 0, "file").when(i == 1, "image_url").otherwise("document_url")
    url = F.when(i == 1, "data:image/png;base64,AA==").when(i == 2, "https://x.example/a.pdf").when(i == 3, "AA==")
    doc = F.struct(kind.alias("type"), F.when(kind == "document_url", url).alias("document_url"), F.when(kind == "image_url", url).alias("image_url"))
    return s.select("service_page_id", select_document(doc).alias("payload"))


def readings_truncated(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    n = F.size(F.split("content", " "))
    return b.filter(K.reading_truncated(n, F.col("content").endswith("."), F.lit(40))).select("block_id", n.alias("tokens"))


def environment_builds(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    v = F.element_at(F.array(F.lit("2.4.0+cu121"), F.lit("2.4.0+cpu"), F.lit("2.4.0"), F.lit("2.4.0+rocm6"), F.lit(None).cast("string")), (F.col("p_size") % 5 + 1).cast("int"))
    build = K.torch_build(v)
    return p.select("p_partkey", build.alias("build"), K.satisfies(build, F.lit("cpu")).alias("serves_cpu"))


def models_missing(spark: SparkSession, d: str) -> DataFrame:
    """Nations as models, their suppliers as files."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("model"))
    s = table(spark, d, "supplier")
    name = F.element_at(F.array(F.lit("config.json"), F.lit("tokenizer.json"), F.lit("a.safetensors")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return K.models_missing(n, s.select(F.col("s_nationkey").alias("model"), name.alias("name")), ["config.json", "tokenizer.json"])


def pages_unanswered(spark: SparkSession, d: str) -> DataFrame:
    """Finished pages without an answer of the service, and pages next to each other that both have one."""
    p = table(spark, d, "page_info").filter("finished").select("book_id", "page_index")
    return p.join(service_pages(spark, d).select("book_id", "page_index").distinct(), ["book_id", "page_index"], "left_anti")


QUERIES = {
    f.__name__: f
    for f in (page_frames, prompts_by_page, settings_merge, model_payloads, task_prompts, region_json, request_bodies, document_payloads, readings_truncated, environment_builds, models_missing, pages_unanswered)
}
SQL = {
    "page_frames": """WITH RECURSIVE o AS (SELECT DISTINCT p_partkey AS id, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END AS parent, CASE WHEN p_partkey % 7 = 0 THEN p_size END AS crop, CASE WHEN p_partkey % 3 = 0 THEN p_size * 2 END AS media, CASE WHEN p_partkey % 5 = 0 THEN p_size * 90 - 900 END AS rotate FROM part),
u AS (SELECT id, 0 AS depth, parent, crop, media, rotate FROM o UNION ALL SELECT u.id, depth + 1, o.parent, o.crop, o.media, o.rotate FROM u JOIN o ON o.id = u.parent)
SELECT id, CAST(arg_min(coalesce(crop, media), depth) FILTER (crop IS NOT NULL OR media IS NOT NULL) AS BIGINT) AS frame, CAST(((coalesce(arg_min(rotate, depth) FILTER (rotate <> 0), 0) % 360) + 360) % 360 AS BIGINT) AS rotation FROM u GROUP BY id""",
    "prompts_by_page": "SELECT book_id, page_index, CASE WHEN page_index % 2 = 0 THEN 'Translate into ' || l || '.' ELSE 'Translate.' || chr(10) || chr(10) || 'Target language: ' || l END AS prompt FROM (SELECT *, CASE WHEN page_index % 5 = 0 THEN 'Simplified Chinese' ELSE target_lang END AS l FROM page_info)",
    "settings_merge": "SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 16 ELSE event_id % 40 END AS INTEGER) AS batch, event_id % 2 <> 0 AS auto FROM events",
    "model_payloads": "SELECT s_suppkey, NOT (s_suppkey % 2 = 0 AND s_suppkey % 3 = 0) AS sent, CASE WHEN NOT (s_suppkey % 2 = 0 AND s_suppkey % 3 = 0) THEN 'm' END AS model FROM supplier",
    "task_prompts": f"WITH {REGIONS} SELECT label, CASE label WHEN 'table' THEN 'Table Recognition:' WHEN 'formula' THEN 'Formula Recognition:' WHEN 'chart' THEN 'Chart Recognition:' ELSE 'OCR:' END AS prompt, count(*) AS regions FROM rg GROUP BY 1, 2",
    "region_json": f"""WITH {REGIONS} SELECT result_id, seq, '{{"label":"' || label || '","score":' || CAST(round(score, 4) AS VARCHAR) || ',"rect":[' || CAST(x1 AS INTEGER) || ',' || CAST(y1 AS INTEGER) || ',' || CAST(x2 AS INTEGER) || ',' || CAST(y2 AS INTEGER) || ']}}' AS json FROM rg""",
    "request_bodies": f"WITH {BLOCKS} SELECT block_id, [{', '.join(repr(x) for x in C.PROTOCOLS)}][CAST(block_id % 3 + 1 AS INTEGER)] AS protocol, true AS asked, content AS answer FROM bl WHERE type = 'paragraph_title'",
    "document_payloads": f"WITH {SERVICE} SELECT service_page_id, CASE service_page_id % 5 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'data uri' WHEN 2 THEN 'remote url refused' WHEN 3 THEN 'base64' ELSE 'missing' END AS payload FROM sp",
    "readings_truncated": f"WITH {BLOCKS} SELECT block_id, CAST(len(string_split(content, ' ')) AS INTEGER) AS tokens FROM bl WHERE len(string_split(content, ' ')) >= 40 AND NOT ends_with(content, '.')",
    "environment_builds": "SELECT p_partkey, ['cuda', 'cpu', 'default', 'rocm', 'missing'][CAST(p_size % 5 + 1 AS INTEGER)] AS build, p_size % 5 IN (0, 1) AS serves_cpu FROM part",
    "models_missing": "SELECT n_nationkey AS model FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey % 3) = 3)",
    "pages_unanswered": "SELECT book_id, page_index FROM page_info WHERE finished AND NOT EXISTS (SELECT 1 FROM service_pages s WHERE s.book_id = page_info.book_id AND s.page_index = page_info.page_index)",
}

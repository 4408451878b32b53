"""Queries on tables, service pages and translation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import geom as G
from pagewright.operators import pages as P
from pagewright.operators import tables as A
from pagewright.operators import translation as X
from pagewright.session import table

from .texts import _NESTED, _RESOLVE, _TRANS, _trim
from .views import BLOCKS, REGIONS, SERVICE, blocks, regions, service_pages


def _page_info(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_info")


# -- tables -------------------------------------------------------------------------------------------------------------


def marked(spark: SparkSession, d: str) -> DataFrame:
    """Table contents, with wide and ragged cells made of them by row: every third row loses its last cell, every row with an
    even number gets a widening mark."""
    t = blocks(spark, d).filter("type = 'table'").select("block_id", F.split("content", "<nl>").alias("l"))
    ragged = F.transform("l", lambda x, i: F.when(i % 3 == 2, F.regexp_replace(x, "<fcel>[^<]*$", "")).when(i % 2 == 0, F.concat(x, F.lit("<lcel>"))).otherwise(x))
    return t.select("block_id", F.array_join(ragged, "<nl>").alias("content"))


_MARKED = (
    BLOCKS
    + r""", t AS (SELECT block_id, string_split(content, '<nl>') AS l FROM bl WHERE type = 'table'),
ln AS (SELECT block_id, i, CASE WHEN i % 3 = 2 THEN regexp_replace(l[i + 1], '<fcel>[^<]*$', '') WHEN i % 2 = 0 THEN l[i + 1] || '<lcel>' ELSE l[i + 1] END AS x FROM t, unnest(range(len(l))) AS u(i)),
mk AS (SELECT block_id, i, j, regexp_extract_all(x, '<[flueX]cel>|<xcel>')[j + 1] AS mark, regexp_split_to_array(x, '<[fleux]cel>')[j + 2] AS txt FROM ln, unnest(range(len(regexp_extract_all(x, '<[flueX]cel>|<xcel>')))) AS u(j)),
gr AS (SELECT *, sum(CASE WHEN mark = '<lcel>' THEN 0 ELSE 1 END) OVER (PARTITION BY block_id, i ORDER BY j) AS g FROM mk),
ce AS (SELECT block_id, i, g, CASE WHEN g = 0 THEN '' ELSE arg_min(trim(txt), j) END AS text, count(*) AS colspan FROM gr GROUP BY block_id, i, g),
ro AS (SELECT block_id, i, row_number() OVER (PARTITION BY block_id ORDER BY i) - 1 AS row, sum(colspan) AS slots, count(*) AS n FROM ce GROUP BY block_id, i),
gd AS (SELECT block_id, max(slots) AS cols, count(*) AS rows FROM ro GROUP BY block_id),
ca AS (SELECT block_id, row, row_number() OVER (PARTITION BY block_id, row ORDER BY g) - 1 AS cell, text, colspan FROM
 (SELECT block_id, row, g, text, colspan FROM ce JOIN ro USING (block_id, i) UNION ALL SELECT block_id, row, 1000, '', cols - slots FROM ro JOIN gd USING (block_id) WHERE slots < cols))
"""
)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    g = marked(spark, d).select("block_id", A.parse_marks(F.col("content")).alias("g"))
    r = g.select("block_id", F.posexplode("g.rows").alias("row", "r"))
    return r.select("block_id", "row", F.posexplode("r.cells").alias("cell", "c"))


def table_parse_marks(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select("block_id", "row", "cell", "c.text", "c.colspan")


def table_cells_slots(spark: SparkSession, d: str) -> DataFrame:
    """Grids as a relation: every cell with the slot it starts at."""
    from pyspark.sql import Window as W

    before = F.sum("c.colspan").over(W.partitionBy("block_id", "row").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    return _cells(spark, d).select("block_id", "row", F.coalesce(before, F.lit(0)).cast("bigint").alias("slot"), F.col("c.colspan").alias("colspan"))


def table_grid_stats(spark: SparkSession, d: str) -> DataFrame:
    g = marked(spark, d).select("block_id", A.parse_marks(F.col("content")).alias("g")).filter("g is not null")
    return g.select("block_id", "g.cols", F.size("g.rows").alias("rows"), F.array_join(A.row_lengths(F.col("g")), ",").alias("row_lengths"))


def table_payload(spark: SparkSession, d: str) -> DataFrame:
    t = blocks(spark, d).filter("type = 'table'").select("block_id", A.parse_marks(F.col("content")).alias("g")).filter("g is not null")
    return t.select("block_id", A.source_matrix(F.col("g")).alias("matrix"), A.human_text(F.col("g")).alias("text"))


def table_matrix_validate(spark: SparkSession, d: str) -> DataFrame:
    """Translated tables by whether their matrix has the grid's shape (every seventh is cut short), and their cells shown."""
    t = blocks(spark, d).filter("type = 'table' and translation is not null")
    value = F.when(F.col("block_id") % 7 == 0, F.regexp_replace("translation", r', \[[^\]]*\]\]$', "]")).otherwise(F.col("translation"))
    t = t.select("block_id", A.parse_marks(F.col("content")).alias("g"), value.alias("v"))
    return t.select("block_id", A.translated_matrix(F.col("v"), F.col("g")).isNotNull().alias("fits"))


def table_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Grids after reading: the stored one, or for tables without one what their content parses to."""
    b = blocks(spark, d).filter("type = 'table'")
    g = F.coalesce(F.col("grid"), A.parse_any(F.col("content")).cast(A.GRID))
    return b.select("block_id", F.col("grid").isNull().alias("filled"), g["cols"].alias("cols"), F.size(g["rows"]).alias("rows"))


def table_parse_html(spark: SparkSession, d: str) -> DataFrame:
    """The tables written as HTML, with a spanning first cell, and read back."""
    t = blocks(spark, d).filter("type = 'table'").select("block_id", A.parse_marks(F.col("content")).alias("g"))
    cells = lambda r: F.array_join(F.transform(r["cells"], lambda c, i: F.concat(F.when(i == 0, F.lit("<td rowspan=2>")).otherwise(F.lit("<TD>")), F.replace(c["text"], F.lit("&"), F.lit("&amp;")))), "")
    body = F.array_join(F.transform("g.rows", lambda r: F.concat(F.lit("<tr>"), cells(r))), "")
    h = t.select("block_id", A.parse_html(F.concat(F.lit("<p>x</p><table>"), body, F.lit("</table>"))).alias("g"))
    r = h.select("block_id", F.posexplode("g.rows").alias("row", "r"))
    return r.select("block_id", "row", F.size("r.cells").alias("cells"), F.array_join(F.transform("r.cells", lambda c: c["text"]), "|").alias("text"))


# -- service pages ------------------------------------------------------------------------------------------------------


def _placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return P.place(service_pages(spark, d), _page_info(spark, d).select("book_id", "page_index", "width_pt", "height_pt"))


def pages_place(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d)[0].select("service_page_id", "pos", "type", "x1", "y1", "x2", "y2")


def pages_refused(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d)[1].select("service_page_id", "reason")


def placed_blocks(spark: SparkSession, d: str) -> DataFrame:
    return P.placed_blocks(service_pages(spark, d), _page_info(spark, d).select("book_id", "page_index", "width_pt", "height_pt"))


def pages_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """A batch a book: its finished pages are asked for; the answers count from 0 for books whose id starts with a digit,
    absolutely for others."""
    p = _page_info(spark, d).filter("finished").select(F.col("book_id").alias("batch"), "page_index")
    local = F.col("batch").rlike("^[0-9]")
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("batch").orderBy("page_index")) - 1
    answered = p.select("batch", F.when(local, rank).otherwise(F.col("page_index") - 1).alias("index"))
    return P.reconcile(p, answered)


def page_to_foreign(spark: SparkSession, d: str) -> DataFrame:
    """Regions as a foreign service would answer them, images of under 60 pixels left out, two images a page at most."""
    text = blocks(spark, d).select("book_id", "page_index", F.col("block_pos").cast("bigint").alias("seq"), F.col("content").alias("markdown"))
    r = regions(spark, d).join(text, ["book_id", "page_index", "seq"], "left").withColumn("page", F.col("page_index") - 1)
    return P.as_service_page(r, 60, 2).select("result_id", "seq", "type", "label", "image_id", F.coalesce("content", F.lit("")).alias("content"))


def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    """A page's text: its contents in order with blank lines between."""
    b = blocks(spark, d).filter("content <> ''").groupBy("book_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("block_pos", "content"))).alias("l"))
    return b.select("book_id", "page_index", F.array_join(F.col("l.content"), "\n\n").alias("markdown"))


def blocks_map_native(spark: SparkSession, d: str) -> DataFrame:
    """Blocks as stored: labels kept, images without content, boxes in points of two places."""
    b = blocks(spark, d).filter("size(loc) = 4")
    at = [G.to_points(F.col("loc")[i] * 2, F.lit(2.0)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return b.select("block_id", "type", F.when(F.col("type") == "image", "").otherwise(F.col("content")).alias("content"), *at)


# -- translation --------------------------------------------------------------------------------------------------------


def _bp(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = blocks(spark, d).select("book_id", "page_index", "block_pos", "block_id", "type", "content", "translation")
    return b, _page_info(spark, d).select("book_id", "page_index", "finished", "translated")


def page_work(spark: SparkSession, d: str) -> DataFrame:
    return X.page_work(*_bp(spark, d))


def requests_collect(spark: SparkSession, d: str) -> DataFrame:
    return X.requests(*_bp(spark, d)).filter("type <> 'table'").select("book_id", "page_index", "index", "block_pos", "q")


def requests_tables(spark: SparkSession, d: str) -> DataFrame:
    """Requests by page, tables among them."""
    r = X.requests(*_bp(spark, d))
    return r.groupBy("book_id", "page_index").agg(F.count("*").alias("requests"), F.count_if(F.col("type") == "table").alias("tables"))


def context_before(spark: SparkSession, d: str) -> DataFrame:
    return X.context(*_bp(spark, d), "before").select("book_id", "page_index", "index", "block_pos")


def context_after(spark: SparkSession, d: str) -> DataFrame:
    return X.context(*_bp(spark, d), "after").select("book_id", "page_index", "index", "block_pos")


def stride_phases(spark: SparkSession, d: str) -> DataFrame:
    return X.phases(_page_info(spark, d).filter("finished")).select("book_id", "page_index", F.col("phase").cast("bigint").alias("phase"))


def replies(spark: SparkSession, d: str) -> DataFrame:
    """A model's replies to the requests, made of them: by page number fenced, with numeric indexes, one item short, without
    an index, or no JSON at all."""
    r = X.requests(*_bp(spark, d))
    m = F.col("page_index") % 5
    index = F.when(m == 3, F.lit("null")).when(m == 1, F.col("index")).otherwise(F.concat(F.lit('"'), "index", F.lit('"')))
    value = F.when((F.col("type") == "table") & (m == 0), F.col("q")).otherwise(F.upper(F.left("q", F.lit(40))))  # elsewhere tables lose their shape
    item = F.concat(F.lit('{"index":'), index, F.lit(',"A":'), F.to_json(F.array(value)), F.lit("}"))
    item = F.regexp_replace(F.regexp_replace(item, r'"A":\[', '"A":'), r"\]\}$", "}")
    r = r.select("book_id", "page_index", "block_pos", item.alias("item"))
    p = r.groupBy("book_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("block_pos", "item"))).alias("l"))
    items = F.when(F.col("page_index") % 5 == 2, F.slice("l.item", F.lit(1), F.size("l") - 1)).otherwise(F.col("l.item"))
    body = F.concat(F.lit('{"result":['), F.array_join(items, ","), F.lit("]}"))
    m = F.col("page_index") % 5
    raw = F.when(m == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(m == 4, F.lit("I have done it.")).otherwise(body)
    return p.select("book_id", "page_index", raw.alias("raw"))


def reply_parse(spark: SparkSession, d: str) -> DataFrame:
    i = X.parse_replies(replies(spark, d))
    return i.groupBy("book_id", "page_index").agg(F.bool_and("ok").alias("ok"), F.count("index").alias("items"))


def reply_validate(spark: SparkSession, d: str) -> DataFrame:
    return X.validate(X.requests(*_bp(spark, d)), X.parse_replies(replies(spark, d)))


def apply_result(spark: SparkSession, d: str) -> DataFrame:
    """Translated blocks of each page after the replies."""
    b, p = _bp(spark, d)
    out = X.apply_values(b, X.requests(b, p), X.parse_replies(replies(spark, d)))
    return out.groupBy("book_id", "page_index").agg(F.count("translation").alias("translated"), F.count("grid").alias("grids"), F.count("*").alias("blocks"))


def bypass_apply(spark: SparkSession, d: str) -> DataFrame:
    return X.bypass(*_bp(spark, d)).filter("type <> 'table'").select("block_id", "translation")


QUERIES = {
    f.__name__: f
    for f in (
        placed_blocks, table_parse_marks, table_cells_slots, table_grid_stats, table_payload, table_matrix_validate, table_backfill, table_parse_html, pages_place, pages_refused, pages_reconcile, page_to_foreign,
        page_markdown, blocks_map_native, page_work, requests_collect, requests_tables, context_before, context_after, stride_phases, reply_parse, reply_validate, apply_result, bypass_apply,
    )
}

_R = "floor(({0}) * 100 + 0.5) / 100"
_FINE = f"type IN ({_TRANS}) AND {_trim('content')} <> ''"
_RT = f"""rq AS (SELECT bl.*, coalesce(p.translated, false) AS done FROM bl JOIN page_info p USING (book_id, page_index) WHERE p.finished AND {_FINE} AND translation IS NULL AND (NOT coalesce(p.translated, false) OR type = 'table') AND (type <> 'table' OR regexp_matches(content, '<[fleux]cel>'))),
rn AS (SELECT *, row_number() OVER (PARTITION BY book_id, page_index ORDER BY block_pos) - 1 AS idx, count(*) OVER (PARTITION BY book_id, page_index) AS n FROM rq)"""
_NAT = ", ".join(f"'{a}': '{b}'" for a, b in P.NATIVE_TO_FOREIGN.items())
_SIZED = "width_pt > 0 AND height_pt > 0 AND NOT isnan(width_pt)"
_DRIFT = f"""dr AS (SELECT sp.*, width_pt AS pw, height_pt AS ph, CAST(dimensions.width AS DOUBLE) AS w, CAST(dimensions.height AS DOUBLE) AS h,
 CASE WHEN {_SIZED} AND dimensions.width > 1 AND dimensions.height > 1 THEN abs((width_pt / height_pt - CAST(dimensions.width AS DOUBLE) / dimensions.height) / (width_pt / height_pt)) END AS drift FROM sp LEFT JOIN page_info USING (book_id, page_index)),
ve AS (SELECT *, CASE WHEN w IS NULL OR h IS NULL THEN 'no dimensions' WHEN NOT (w > 1 AND h > 1) THEN 'unusable dimensions' WHEN drift IS NULL THEN 'no page size' WHEN drift > 0.02 THEN 'other page box' WHEN blocks IS NULL THEN 'no blocks' END AS reason FROM dr)"""


def _at(c: str, own: str, page: str) -> str:
    return _R.format(f"least(greatest(CAST(blocks[i].{c} AS DOUBLE) * ({page} / {own}), 0.0), {page})")


def _context(order: str, step: str) -> str:
    return f"""WITH {BLOCKS}, c AS (SELECT *, row_number() OVER (PARTITION BY book_id, page_index ORDER BY block_pos {order}) AS rn FROM bl WHERE {_FINE}),
k AS (SELECT book_id, page_index AS nb, block_pos, row_number() OVER (PARTITION BY book_id, page_index ORDER BY block_pos) - 1 AS idx FROM c WHERE rn <= 3)
SELECT p.book_id, p.page_index, CAST(idx AS VARCHAR) AS index, block_pos FROM page_info p JOIN k ON k.book_id = p.book_id AND k.nb = p.page_index {step} 1"""


SQL = {
    "table_parse_marks": f"WITH {_MARKED} SELECT block_id, CAST(row AS INTEGER) AS row, CAST(cell AS INTEGER) AS cell, text, CAST(colspan AS INTEGER) AS colspan FROM ca",
    "table_cells_slots": f"WITH {_MARKED} SELECT block_id, CAST(row AS INTEGER) AS row, CAST(coalesce(sum(colspan) OVER (PARTITION BY block_id, row ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS slot, CAST(colspan AS INTEGER) AS colspan FROM ca",
    "table_grid_stats": f"WITH {_MARKED}, l AS (SELECT block_id, row, count(*) AS n FROM ca GROUP BY 1, 2) SELECT block_id, CAST(any_value(cols) AS INTEGER) AS cols, CAST(any_value(rows) AS INTEGER) AS rows, string_agg(n, ',' ORDER BY row) AS row_lengths FROM l JOIN gd USING (block_id) GROUP BY 1",
    "table_payload": f"""WITH {BLOCKS}, t AS (SELECT block_id, list_transform(string_split(content, '<nl>'), lambda x: list_transform(string_split(x, '<fcel>')[2:], lambda y: trim(y))) AS m FROM bl WHERE type = 'table' AND regexp_matches(content, '<fcel>'))
SELECT block_id, '[' || array_to_string(list_transform(m, lambda r: '[' || array_to_string(list_transform(r, lambda x: '"' || x || '"'), ',') || ']'), ',') || ']' AS matrix, array_to_string(list_transform(m, lambda r: array_to_string(r, ' | ')), chr(10)) AS text FROM t""",
    "table_matrix_validate": f"WITH {BLOCKS} SELECT block_id, block_id % 7 <> 0 OR len(string_split(content, '<nl>')) = 1 AS fits FROM bl WHERE type = 'table' AND translation IS NOT NULL",
    "table_backfill": f"WITH {BLOCKS} SELECT block_id, grid IS NULL AS filled, CASE WHEN grid IS NOT NULL THEN grid.cols WHEN regexp_matches(content, '<fcel>') THEN CAST(len(string_split(string_split(content, '<nl>')[1], '<fcel>')) - 1 AS INTEGER) END AS cols, CASE WHEN grid IS NOT NULL THEN CAST(len(grid.rows) AS INTEGER) WHEN regexp_matches(content, '<fcel>') THEN CAST(len(string_split(content, '<nl>')) AS INTEGER) END AS rows FROM bl WHERE type = 'table'",
    "pages_refused": f"WITH {SERVICE}, {_DRIFT} SELECT service_page_id, reason FROM ve WHERE reason IS NOT NULL",
    "pages_place": f"""WITH {_NESTED}, {_DRIFT}, b AS (SELECT service_page_id, CAST(i - 1 AS INTEGER) AS pos, {_at("top_left_x", "w", "pw")} AS x1, {_at("top_left_y", "h", "ph")} AS y1, {_at("bottom_right_x", "w", "pw")} AS x2, {_at("bottom_right_y", "h", "ph")} AS y2
 FROM ve, unnest(range(1, len(blocks) + 1)) AS u(i) WHERE reason IS NULL), k AS (SELECT service_page_id, pos, {_RESOLVE} AS type, content FROM n)
SELECT service_page_id, pos, type, x1, y1, x2, y2 FROM b JOIN k USING (service_page_id, pos) WHERE x2 - x1 >= 0.5 AND y2 - y1 >= 0.5 AND (type = 'image' OR coalesce({_trim("content")}, '') <> '')""",
    "pages_reconcile": """WITH p AS (SELECT book_id AS batch, page_index, row_number() OVER (PARTITION BY book_id ORDER BY page_index) - 1 AS rank, max(page_index) OVER (PARTITION BY book_id) AS high, min(page_index) OVER (PARTITION BY book_id) AS low, count(*) OVER (PARTITION BY book_id) AS n FROM page_info WHERE finished)
SELECT batch, page_index, CAST(CASE WHEN regexp_matches(batch, '^[0-9]') THEN rank ELSE page_index - 1 END AS INTEGER) AS answer, regexp_matches(batch, '^[0-9]') OR (high = n AND low = 1) AS local, 'ok' AS status FROM p""",
    "page_to_foreign": f"""WITH {REGIONS}, {BLOCKS}, k AS (SELECT rg.*, coalesce(MAP {{{_NAT}}}[label], 'text') AS type, coalesce(content, '') AS c FROM rg LEFT JOIN bl ON bl.book_id = rg.book_id AND bl.page_index = rg.page_index AND bl.block_pos = rg.seq),
m AS (SELECT *, row_number() OVER (PARTITION BY result_id, type ORDER BY seq) - 1 AS k FROM k WHERE type <> 'image' OR least(x2 - x1, y2 - y1) >= 60)
SELECT result_id, seq, type, label, CASE WHEN type = 'image' THEN 'img-' || (page_index - 1) || '-' || k END AS image_id, CASE WHEN type = 'image' THEN '' ELSE c END AS content FROM m WHERE type <> 'image' OR k < 2""",
    "page_markdown": f"WITH {BLOCKS} SELECT book_id, page_index, string_agg(content, chr(10) || chr(10) ORDER BY block_pos, content) AS markdown FROM bl WHERE content <> '' GROUP BY 1, 2",
    "blocks_map_native": f"WITH {BLOCKS} SELECT block_id, type, CASE WHEN type = 'image' THEN '' ELSE content END AS content, {', '.join(_R.format(f'loc[{i}] * 2 / 2') + f' AS {c}' for i, c in enumerate(('x1', 'y1', 'x2', 'y2'), 1))} FROM bl WHERE len(loc) = 4",
    "page_work": f"""WITH {BLOCKS}, s AS (SELECT book_id, page_index, count(*) FILTER ({_FINE} AND translation IS NULL) AS pending, count(*) FILTER ({_FINE} AND translation IS NULL AND type = 'table') AS t FROM bl GROUP BY 1, 2)
SELECT book_id, page_index, NOT finished AS needs_ocr, finished AND NOT coalesce(translated, false) AS needs_translation, finished AND coalesce(translated, false) AND coalesce(t, 0) > 0 AS needs_tables, coalesce(pending, 0) AS pending FROM page_info LEFT JOIN s USING (book_id, page_index)""",
    "requests_collect": f"WITH {BLOCKS}, {_RT} SELECT book_id, page_index, CAST(idx AS VARCHAR) AS index, block_pos, content AS q FROM rn WHERE type <> 'table'",
    "requests_tables": f"WITH {BLOCKS}, {_RT} SELECT book_id, page_index, count(*) AS requests, count(*) FILTER (type = 'table') AS tables FROM rn GROUP BY 1, 2",
    "context_before": _context("DESC", "-"),
    "context_after": _context("", "+"),
    "stride_phases": "SELECT book_id, page_index, (row_number() OVER (PARTITION BY book_id ORDER BY page_index) - 1) % 2 AS phase FROM page_info WHERE finished",
    "reply_parse": f"WITH {BLOCKS}, {_RT} SELECT book_id, page_index, page_index % 5 NOT IN (3, 4) AS ok, CASE WHEN page_index % 5 IN (3, 4) THEN 0 WHEN page_index % 5 = 2 THEN count(*) - 1 ELSE count(*) END AS items FROM rn GROUP BY 1, 2",
    "reply_validate": f"""WITH {BLOCKS}, {_RT}, a AS (SELECT *, page_index % 5 AS m, type = 'table' AND (page_index % 5 = 1 OR (page_index % 5 = 2 AND idx < n - 1)) AS bad FROM rn)
SELECT book_id, page_index, CASE WHEN m IN (3, 4) THEN count(*) WHEN m = 2 THEN 1 ELSE 0 END AS missing, CAST(0 AS BIGINT) AS unasked, CAST(0 AS BIGINT) AS repeated, count(*) FILTER (bad) AS misshapen, m IN (0, 1) AND count(*) FILTER (bad) = 0 AS valid FROM a GROUP BY book_id, page_index, m""",
    "apply_result": f"""WITH {BLOCKS}, {_RT}, v AS (SELECT book_id, page_index, page_index % 5 = 0 OR (page_index % 5 = 1 AND count(*) FILTER (type = 'table') = 0) AS valid FROM rn GROUP BY 1, 2)
SELECT bl.book_id, bl.page_index, count(*) FILTER (bl.translation IS NOT NULL OR (rn.idx IS NOT NULL AND v.valid)) AS translated, count(*) FILTER (rn.type = 'table' AND v.valid) AS grids, count(*) AS blocks FROM bl LEFT JOIN rn USING (block_id) LEFT JOIN v ON v.book_id = bl.book_id AND v.page_index = bl.page_index GROUP BY 1, 2""",
    "bypass_apply": f"WITH {BLOCKS} SELECT block_id, CASE WHEN translation IS NULL AND p.finished AND NOT coalesce(p.translated, false) AND {_FINE} THEN content ELSE translation END AS translation FROM bl LEFT JOIN page_info p USING (book_id, page_index) WHERE type <> 'table'",
}

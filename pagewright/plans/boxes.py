"""Queries on rectangles: pairs, projections, filters, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import geom as G
from pagewright.operators import folds
from pagewright.session import table

from .views import BLOCKS, BOXES, REGIONS, RESULTS, SERVICE, blocks, boxes, regions, results, service_pages


# -- the same formulas in SQL, over two prefixes ------------------------------------------------------------------------
def _i(a: str, b: str) -> str:
    return f"greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"


def _a(a: str) -> str:
    return f"({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1)"


def _share(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) > 0 THEN ({n}) / ({d}) ELSE 0.0 END"


def _iou(a: str, b: str) -> str:
    return _share(_i(a, b), f"{_a(a)} + {_a(b)} - {_i(a, b)}")


def _cont(a: str, b: str) -> str:
    return _share(_i(a, b), _a(a))


def _iom(a: str, b: str) -> str:
    return _share(_i(a, b), f"least({_a(a)}, {_a(b)})")


_FIG, _STR = "('image', 'chart')", "('table', 'formula')"
_MEET = "a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2"
_PAIRS = f"FROM boxes a JOIN boxes b ON a.page = b.page AND a.seq < b.seq AND {_MEET}"


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, dict, dict]:
    """Pairs of one page's boxes that overlap: an equi-join on the page with the range test as residual."""
    b = boxes(spark, d)
    left, right = (b.select("page", *(F.col(c).alias(f"{s}_{c}") for c in b.columns if c != "page")) for s in "ab")
    a_box, b_box = ({c: F.col(f"{s}_{c}") for c in b.columns if c != "page"} for s in "ab")
    j = left.join(right, "page").filter((F.col("a_seq") < F.col("b_seq")) & G.overlaps(a_box, b_box))
    return j, a_box, b_box


def _pair_query(measure):
    def q(spark: SparkSession, d: str) -> DataFrame:
        j, a, b = _pairs(spark, d)
        return j.select("page", F.col("a_seq").alias("a"), F.col("b_seq").alias("b"), *measure(a, b))

    return q


def geom_area_rint(spark: SparkSession, d: str) -> DataFrame:
    third = {c: F.rint(F.col(c) / 3).cast("bigint").alias(c) for c in ("x1", "y1", "x2", "y2")}
    return boxes(spark, d).select("page", "seq", G.area(G.box()).alias("area"), *third.values())


def geom_union_group(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).groupBy("page").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("boxes"))


def geom_tiles(spark: SparkSession, d: str) -> DataFrame:
    t = results(spark, d).select("result_id", F.posexplode(G.tiles(F.col("width"), F.col("height"))).alias("tile", "t"))
    return t.select("result_id", "tile", "t.*")


def geom_expand_clamp(spark: SparkSession, d: str) -> DataFrame:
    grown = G.clamp(G.expand(G.box(), 2.0), F.col("width").cast("double"), F.col("height").cast("double"))
    return regions(spark, d).select("result_id", "seq", *(v.alias(c) for c, v in grown.items()))


def geom_downscale(spark: SparkSession, d: str) -> DataFrame:
    f = G.downscale(F.col("width"), F.col("height"), 1400)
    return results(spark, d).select("result_id", f.alias("factor"), F.floor(F.col("width") * f).alias("w"), F.floor(F.col("height") * f).alias("h"))


def geom_scale_to_pt(spark: SparkSession, d: str) -> DataFrame:
    """Native blocks: pixels at scale 2 to points, images without content."""
    return regions(spark, d).select("result_id", "seq", "label", *(G.to_points(F.col(c), F.lit(2.0)).alias(c) for c in ("x1", "y1", "x2", "y2")))


def _size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_info").select("book_id", "page_index", "width_pt", "height_pt")


def geom_aspect_gate(spark: SparkSession, d: str) -> DataFrame:
    """Service pages by how far their render's aspect is from the page's: placed, noticed or refused."""
    s = service_pages(spark, d).select("service_page_id", "book_id", "page_index", F.col("dimensions.width").cast("double").alias("w"), F.col("dimensions.height").cast("double").alias("h"))
    j = s.join(_size(spark, d), ["book_id", "page_index"], "left")
    usable = (F.col("w") > 1) & (F.col("h") > 1)
    sized = (F.col("width_pt") > 0) & (F.col("height_pt") > 0) & ~F.isnan("width_pt")
    expected = F.when(sized, F.col("width_pt") / F.col("height_pt"))
    drift = F.when(usable & sized, F.abs((expected - F.col("w") / F.col("h")) / expected))
    verdict = F.when(F.col("w").isNull() | F.col("h").isNull(), "no dimensions").when(~usable, "unusable dimensions").when(drift.isNull(), "no page size").when(drift > 0.02, "refused").when(drift > 0.005, "noticed").otherwise("placed")
    return j.select("service_page_id", verdict.alias("verdict"))


def geom_overlay_pct(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d).filter("size(loc) = 4").select("block_id", "book_id", "page_index", *(F.col("loc")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))))
    j = b.join(_size(spark, d), ["book_id", "page_index"]).filter("width_pt > 0 and height_pt > 0 and not isnan(width_pt)")
    w, h = F.col("width_pt"), F.col("height_pt")
    return j.select("block_id", (F.col("x1") / w * 100).alias("left_pct"), (F.col("y1") / h * 100).alias("top_pct"), ((F.col("x2") - F.col("x1")) / w * 100).alias("width_pct"), ((F.col("y2") - F.col("y1")) / h * 100).alias("height_pct"))


def geom_page_size(spark: SparkSession, d: str) -> DataFrame:
    """A page's size, or the size of the book's first page that has one."""
    p = _size(spark, d)
    ok = (F.col("width_pt") > 0) & ~F.isnan("width_pt")
    first = p.filter(ok).groupBy("book_id").agg(F.min_by(F.struct("width_pt", "height_pt"), F.col("page_index")).alias("f"))
    j = p.join(first, "book_id", "left")
    return j.select("book_id", "page_index", F.when(ok, F.col("width_pt")).otherwise(F.col("f.width_pt")).alias("width_pt"), F.when(ok, F.col("height_pt")).otherwise(F.col("f.height_pt")).alias("height_pt"))


def geom_zoom(spark: SparkSession, d: str) -> DataFrame:
    """Fit-width zoom of a 900 point wide pane, clamped to 0.1..4 and rounded to three places."""
    p = _size(spark, d).filter("width_pt > 0 and not isnan(width_pt)")
    z = F.floor(F.greatest(F.lit(0.1), F.least(F.lit(4.0), F.lit(900.0) / F.col("width_pt"))) * 1000 + 0.5) / 1000
    return p.select("book_id", "page_index", z.alias("zoom"))


def geom_crop_rect(spark: SparkSession, d: str) -> DataFrame:
    """Crop rectangles cut to the page; what is under two pixels falls away."""
    r = {c: F.rint(c) for c in ("x1", "y1", "x2", "y2")}
    c = {"x1": F.greatest(F.lit(0.0), r["x1"]), "y1": F.greatest(F.lit(0.0), r["y1"]), "x2": F.least(r["x2"], F.col("width").cast("double")), "y2": F.least(r["y2"], F.col("height").cast("double"))}
    out = regions(spark, d).select("result_id", "seq", *(v.cast("bigint").alias(k) for k, v in c.items()))
    return out.filter("x2 - x1 >= 2 and y2 - y1 >= 2")


def box_threshold(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).filter((F.col("score") >= 0.35) & (G.area(G.box()) >= 256)).select("page", "seq", "label")


def _ranked(spark: SparkSession, d: str, *order, name: str) -> DataFrame:
    return boxes(spark, d).select("page", "seq", F.row_number().over(W.partitionBy("page").orderBy(*order, "seq")).cast("bigint").alias(name))


def box_top_by_score(spark: SparkSession, d: str) -> DataFrame:
    """The best regions of a page by score; the feature's own limit is 100 a page, 3 shows it on pages this small."""
    return _ranked(spark, d, F.desc("score"), name="place").filter("place <= 3")


def box_priority_order(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, G.rank(F.col("label")), "origin", F.desc(G.area(G.box())), F.desc("score"), name="place")


def box_reading_order(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, "y1", "x1", name="place")


def box_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Batches of four boxes of one label, as recognition takes them."""
    n = F.row_number().over(W.partitionBy("page", "label").orderBy("seq"))
    return boxes(spark, d).select("page", "label", "seq", F.floor((n - 1) / 4).cast("bigint").alias("batch"))


def box_whitelist(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    ok = F.when(F.col("origin") == 0, True).when(F.col("origin") == 1, F.col("label").isin(folds.RECALL_LABELS)).otherwise(F.col("label").isin(folds.TILE_LABELS))
    return b.filter(ok).groupBy("origin", "label").agg(F.count("*").alias("boxes"))


def box_figure_gate(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).filter("label = 'image' and least(x2 - x1, y2 - y1) >= 100").select("page", "seq")


def figure_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Figures whose inner boxes are three or more or cover a quarter of them."""
    j, a, b = _pairs(spark, d)
    both = j.select("page", F.when(G.is_figure(a), F.col("a_seq")).when(G.is_figure(b), F.col("b_seq")).alias("fig"), F.when(G.is_figure(a), G.area(b)).otherwise(G.area(a)).alias("inner"), F.when(G.is_figure(a), G.area(a)).otherwise(G.area(b)).alias("own"))
    one = both.filter("fig is not null").groupBy("page", "fig").agg(F.count("*").alias("n"), F.sum("inner").alias("inner"), F.max("own").alias("own"))
    return one.select("page", "fig", "n", G.share(F.col("inner"), F.col("own")).alias("coverage")).filter("n >= 3 or coverage >= 0.25")


def text_line_accept(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).filter("y2 - y1 between 12 and 110 and x2 - x1 >= 16 and score between 0.12 and 0.5").select("page", "seq")


def merge_absorb_pairs(spark: SparkSession, d: str) -> DataFrame:
    j, a, b = _pairs(spark, d)
    return j.filter(G.absorbs(a, b)).select("page", F.col("a_seq").alias("a"), F.col("b_seq").alias("b"))


def merge_add_only_fold(spark: SparkSession, d: str) -> DataFrame:
    pages = folds.page_arrays(boxes(spark, d), "page")
    return pages.select("page", F.explode(folds.add_only(F.col("boxes"))).alias("k")).select("page", "k.seq", "k.label", "k.origin")


def merge_pass_counts(spark: SparkSession, d: str) -> DataFrame:
    return merge_add_only_fold(spark, d).groupBy("origin").agg(F.count("*").alias("boxes"), F.countDistinct("page").alias("pages"))


def merge_box_filter(spark: SparkSession, d: str) -> DataFrame:
    """The regions of each recognised page, grown, cut to the page and merged by priority."""
    return folds.merge_boxes(regions(spark, d).withColumn("origin", F.lit(0)), "result_id", size=("width", "height"))


def lines_group_fold(spark: SparkSession, d: str) -> DataFrame:
    pages = folds.page_arrays(boxes(spark, d), "page")
    g = pages.select("page", F.posexplode(folds.group_lines(F.col("boxes"))).alias("grp", "g"))
    return g.select("page", "grp", "g.x1", "g.y1", "g.x2", "g.y2")


def page_region_stats(spark: SparkSession, d: str) -> DataFrame:
    """Pages by what recognition reported: regions, distinct labels, best score, mean share of the page."""
    r = regions(spark, d)
    return r.groupBy("result_id").agg(
        F.count("*").alias("regions"), F.countDistinct("label").alias("labels"), F.max("score").alias("best"),
        F.max(G.area(G.box()) / (F.col("width") * F.col("height"))).alias("largest_share"),
    )


def truncated_pages(spark: SparkSession, d: str) -> DataFrame:
    """Books by pages that recognition reported as truncated (null is not reported)."""
    r = results(spark, d)
    return r.groupBy("book_id").agg(F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("any_truncated"), F.count_if(F.coalesce("truncated", F.lit(False))).alias("truncated_pages"), F.count("*").alias("pages"))


QUERIES = {
    "geom_iou_pairs": _pair_query(lambda a, b: [G.iou(a, b).alias("iou")]),
    "geom_containment_pairs": _pair_query(lambda a, b: [G.containment(a, b).alias("a_in_b"), G.containment(b, a).alias("b_in_a")]),
    "geom_iom_pairs": _pair_query(lambda a, b: [G.iom(a, b).alias("iom")]),
    "geom_union_pairs": _pair_query(lambda a, b: [v.alias(c) for c, v in G.union(a, b).items()]),
} | {
    f.__name__: f
    for f in (
        geom_area_rint, geom_union_group, geom_tiles, geom_expand_clamp, geom_downscale, geom_scale_to_pt, geom_aspect_gate, geom_overlay_pct, geom_page_size, geom_zoom, geom_crop_rect,
        box_threshold, box_top_by_score, box_priority_order, box_reading_order, box_chunks, box_whitelist, box_figure_gate, figure_acceptance, text_line_accept,
        merge_absorb_pairs, merge_add_only_fold, merge_pass_counts, merge_box_filter, lines_group_fold, page_region_stats, truncated_pages,
    )
}

_R2 = "floor({0} * 100 + 0.5) / 100"
_RECALL = ", ".join(f"'{x}'" for x in folds.RECALL_LABELS)
_TILE = ", ".join(f"'{x}'" for x in folds.TILE_LABELS)
_BOX_LIST = "list({'seq': seq, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'label': label, 'score': score, 'origin': origin} ORDER BY "
_ADD = f"""WITH {BOXES}, pages AS (SELECT page, {_BOX_LIST} origin, seq) AS l FROM boxes GROUP BY page),
kept AS (SELECT page, unnest(list_reduce(list_transform(l, lambda b: [b]), lambda acc, c: CASE
  WHEN c[1].origin = 0 OR ((CASE WHEN c[1].origin = 1 THEN c[1].label IN ({_RECALL}) ELSE c[1].label IN ({_TILE}) END)
   AND len(list_filter(acc, lambda k: {_iou("c[1]", "k")} > 0.3 OR (NOT (k.label IN {_FIG} AND c[1].label NOT IN {_FIG}) AND {_cont("c[1]", "k")} > 0.6))) = 0)
  THEN list_concat(acc, c) ELSE acc END, [{{'seq': CAST(-1 AS BIGINT), 'x1': 0.0::DOUBLE, 'y1': 0.0::DOUBLE, 'x2': 0.0::DOUBLE, 'y2': 0.0::DOUBLE, 'label': 'none', 'score': 0.0::DOUBLE, 'origin': 9}}])) AS k FROM pages)
"""
_RANK = f"CASE WHEN label IN {_STR} THEN 0 WHEN label IN {_FIG} THEN 1 ELSE 2 END"
_AREA = "greatest(0.0, x2 - x1) * greatest(0.0, y2 - y1)"


def _place(order: str) -> str:
    return f"SELECT page, seq, row_number() OVER (PARTITION BY page ORDER BY {order}, seq) AS place FROM boxes"


SQL = {
    "geom_iou_pairs": f"WITH {BOXES} SELECT a.page, a.seq AS a, b.seq AS b, {_iou('a', 'b')} AS iou {_PAIRS}",
    "geom_containment_pairs": f"WITH {BOXES} SELECT a.page, a.seq AS a, b.seq AS b, {_cont('a', 'b')} AS a_in_b, {_cont('b', 'a')} AS b_in_a {_PAIRS}",
    "geom_iom_pairs": f"WITH {BOXES} SELECT a.page, a.seq AS a, b.seq AS b, {_iom('a', 'b')} AS iom {_PAIRS}",
    "geom_union_pairs": f"WITH {BOXES} SELECT a.page, a.seq AS a, b.seq AS b, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1, greatest(a.x2, b.x2) AS x2, greatest(a.y2, b.y2) AS y2 {_PAIRS}",
    "geom_area_rint": f"WITH {BOXES} SELECT page, seq, {_AREA} AS area, CAST(round_even(x1 / 3, 0) AS BIGINT) AS x1, CAST(round_even(y1 / 3, 0) AS BIGINT) AS y1, CAST(round_even(x2 / 3, 0) AS BIGINT) AS x2, CAST(round_even(y2 / 3, 0) AS BIGINT) AS y2 FROM boxes",
    "geom_union_group": f"WITH {BOXES} SELECT page, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS boxes FROM boxes GROUP BY page",
    "geom_tiles": f"""WITH {RESULTS} SELECT result_id, CAST(t AS INTEGER) AS tile, 0 AS x1, CAST(CASE WHEN t = 0 THEN 0 ELSE greatest(0, height // 2 - CAST(floor(height * 0.08) AS INTEGER)) END AS INTEGER) AS y1,
 width AS x2, CAST(CASE WHEN t = 0 THEN least(height, height // 2 + CAST(floor(height * 0.08) AS INTEGER)) ELSE height END AS INTEGER) AS y2 FROM pr, unnest([0, 1]) AS u(t) WHERE height >= 200""",
    "geom_expand_clamp": f"WITH {REGIONS} SELECT result_id, seq, greatest(0.0, x1 - 2) AS x1, greatest(0.0, y1 - 2) AS y1, least(x2 + 2, CAST(width AS DOUBLE)) AS x2, least(y2 + 2, CAST(height AS DOUBLE)) AS y2 FROM rg",
    "geom_downscale": f"WITH {RESULTS} SELECT result_id, f AS factor, CAST(floor(width * f) AS BIGINT) AS w, CAST(floor(height * f) AS BIGINT) AS h FROM (SELECT *, CASE WHEN greatest(width, height) > 1400 THEN CAST(1400 AS DOUBLE) / greatest(width, height) ELSE CAST(1 AS DOUBLE) END AS f FROM pr)",
    "geom_scale_to_pt": f"WITH {REGIONS} SELECT result_id, seq, label, {', '.join(_R2.format(f'({c} / 2.0::DOUBLE)') + f' AS {c}' for c in ('x1', 'y1', 'x2', 'y2'))} FROM rg",
    "geom_aspect_gate": f"""WITH {SERVICE}, j AS (SELECT service_page_id, CAST(dimensions.width AS DOUBLE) AS w, CAST(dimensions.height AS DOUBLE) AS h, width_pt, height_pt FROM sp LEFT JOIN page_info USING (book_id, page_index)),
k AS (SELECT *, CASE WHEN w > 1 AND h > 1 AND width_pt > 0 AND height_pt > 0 AND NOT isnan(width_pt) THEN abs((width_pt / height_pt - w / h) / (width_pt / height_pt)) END AS drift FROM j)
SELECT service_page_id, CASE WHEN w IS NULL OR h IS NULL THEN 'no dimensions' WHEN NOT (w > 1 AND h > 1) THEN 'unusable dimensions' WHEN drift IS NULL THEN 'no page size' WHEN drift > 0.02 THEN 'refused' WHEN drift > 0.005 THEN 'noticed' ELSE 'placed' END AS verdict FROM k""",
    "geom_overlay_pct": f"WITH {BLOCKS} SELECT block_id, loc[1] / width_pt * 100 AS left_pct, loc[2] / height_pt * 100 AS top_pct, (loc[3] - loc[1]) / width_pt * 100 AS width_pct, (loc[4] - loc[2]) / height_pt * 100 AS height_pct FROM bl JOIN page_info USING (book_id, page_index) WHERE len(loc) = 4 AND width_pt > 0 AND height_pt > 0 AND NOT isnan(width_pt)",
    "geom_page_size": """WITH f AS (SELECT book_id, arg_min({'w': width_pt, 'h': height_pt}, page_index) AS f FROM page_info WHERE width_pt > 0 AND NOT isnan(width_pt) GROUP BY 1)
SELECT book_id, page_index, CASE WHEN width_pt > 0 AND NOT isnan(width_pt) THEN width_pt ELSE f.w END AS width_pt, CASE WHEN width_pt > 0 AND NOT isnan(width_pt) THEN height_pt ELSE f.h END AS height_pt FROM page_info LEFT JOIN f USING (book_id)""",
    "geom_zoom": "SELECT book_id, page_index, floor(greatest(0.1, least(4.0, CAST(900 AS DOUBLE) / width_pt)) * 1000 + 0.5) / 1000 AS zoom FROM page_info WHERE width_pt > 0 AND NOT isnan(width_pt)",
    "geom_crop_rect": f"WITH {REGIONS} SELECT * FROM (SELECT result_id, seq, CAST(greatest(0, x1) AS BIGINT) AS x1, CAST(greatest(0, y1) AS BIGINT) AS y1, CAST(least(x2, width) AS BIGINT) AS x2, CAST(least(y2, height) AS BIGINT) AS y2 FROM rg) WHERE x2 - x1 >= 2 AND y2 - y1 >= 2",
    "box_threshold": f"WITH {BOXES} SELECT page, seq, label FROM boxes WHERE score >= 0.35 AND {_AREA} >= 256",
    "box_top_by_score": f"WITH {BOXES} SELECT * FROM ({_place('score DESC')}) WHERE place <= 3",
    "box_priority_order": f"WITH {BOXES} {_place(f'{_RANK}, origin, {_AREA} DESC, score DESC')}",
    "box_reading_order": f"WITH {BOXES} {_place('y1, x1')}",
    "box_chunks": f"WITH {BOXES} SELECT page, label, seq, (row_number() OVER (PARTITION BY page, label ORDER BY seq) - 1) // 4 AS batch FROM boxes",
    "box_whitelist": f"WITH {BOXES} SELECT origin, label, count(*) AS boxes FROM boxes WHERE origin = 0 OR (origin = 1 AND label IN ({_RECALL})) OR (origin = 2 AND label IN ({_TILE})) GROUP BY 1, 2",
    "box_figure_gate": f"WITH {BOXES} SELECT page, seq FROM boxes WHERE label = 'image' AND least(x2 - x1, y2 - y1) >= 100",
    "figure_acceptance": f"""WITH {BOXES}, p AS (SELECT a.page, CASE WHEN a.label IN {_FIG} THEN a.seq WHEN b.label IN {_FIG} THEN b.seq END AS fig,
 CASE WHEN a.label IN {_FIG} THEN {_a("b")} ELSE {_a("a")} END AS inr, CASE WHEN a.label IN {_FIG} THEN {_a("a")} ELSE {_a("b")} END AS own {_PAIRS}),
q AS (SELECT page, fig, count(*) AS n, {_share("sum(inr)", "max(own)")} AS coverage FROM p WHERE fig IS NOT NULL GROUP BY 1, 2) SELECT * FROM q WHERE n >= 3 OR coverage >= 0.25""",
    "text_line_accept": f"WITH {BOXES} SELECT page, seq FROM boxes WHERE y2 - y1 BETWEEN 12 AND 110 AND x2 - x1 >= 16 AND score BETWEEN 0.12 AND 0.5",
    "merge_absorb_pairs": f"WITH {BOXES} SELECT a.page, a.seq AS a, b.seq AS b {_PAIRS} WHERE {_iou('a', 'b')} > 0.5 OR (NOT (b.label IN {_FIG} AND a.label NOT IN {_FIG}) AND {_cont('a', 'b')} > CASE WHEN b.label IN {_STR} THEN 0.25 ELSE 0.35 END)",
    "merge_add_only_fold": _ADD + "SELECT page, k.seq, k.label, k.origin FROM kept WHERE k.seq >= 0",
    "merge_pass_counts": _ADD + "SELECT k.origin, count(*) AS boxes, count(DISTINCT page) AS pages FROM kept WHERE k.seq >= 0 GROUP BY 1",
    "page_region_stats": f"WITH {REGIONS} SELECT result_id, count(*) AS regions, count(DISTINCT label) AS labels, max(score) AS best, max(({_AREA}) / (width * height)) AS largest_share FROM rg GROUP BY 1",
    "truncated_pages": f"WITH {RESULTS} SELECT book_id, coalesce(bool_or(truncated), false) AS any_truncated, count(*) FILTER (truncated) AS truncated_pages, count(*) AS pages FROM pr GROUP BY 1",
}

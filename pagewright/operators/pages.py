"""Pages between the recognition services and the library: answers to requests, placed blocks, and a page as a service
answers it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import geom as G
from pagewright.functions import text as T
from pagewright.operators import folds, tables
from pagewright.session import cut_lineage

ASPECT_LIMIT, ASPECT_NOTICE, LEAST_POINTS = 0.02, 0.005, 0.5
# The client's labels in a service's coarser types.
NATIVE_TO_FOREIGN = {
    "doc_title": "title", "paragraph_title": "title", "figure_title": "caption", "table": "table", "image": "image", "chart": "image", "seal": "signature", "formula": "equation", "formula_number": "equation", "algorithm": "code",
    "reference": "references", "reference_content": "references", "aside_text": "aside_text", "header": "header", "footer": "footer", "footnote": "footer", "vision_footnote": "footer",
}


def verdict(width: Column, height: Column, page_w: Column, page_h: Column, blocks: Column) -> Column:
    """Why a service page can't be placed, or null."""
    sized = (page_w > 0) & (page_h > 0) & ~F.isnan(page_w) & ~F.isnan(page_h)
    expected = F.when(sized, page_w / page_h)
    drift = F.when(sized & (width > 1) & (height > 1), F.abs((expected - width / height) / expected))
    return (
        F.when(width.isNull() | height.isNull(), "no dimensions")
        .when(~((width > 1) & (height > 1)), "unusable dimensions")
        .when(drift.isNull(), "no page size")
        .when(drift > ASPECT_LIMIT, "other page box")
        .when(blocks.isNull(), "no blocks")
    )


def place(pages: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Service pages(service_page_id, book_id, page_index, dimensions, blocks) and page sizes(book_id, page_index, width_pt,
    height_pt) -> (placed blocks in points with client types, refused pages with the reason).

    A page without blocks (null) is refused, one with none (empty) is placed and has no rows. Blocks that are degenerate, and
    blocks other than images without text, fall away."""
    j = pages.join(sizes, ["book_id", "page_index"], "left")
    w, h = F.col("dimensions.width").cast("double"), F.col("dimensions.height").cast("double")
    j = j.withColumn("reason", verdict(w, h, F.col("width_pt"), F.col("height_pt"), F.col("blocks")))
    refused = j.filter("reason is not null").select("service_page_id", "book_id", "page_index", "reason")
    b = j.filter("reason is null").select("service_page_id", "book_id", "page_index", "width_pt", "height_pt", w.alias("w"), h.alias("h"), F.posexplode("blocks").alias("pos", "b"))
    kind = T.resolve_type(F.col("b.type"), F.col("b.label"))
    sides = {"x1": ("top_left_x", "w", "width_pt"), "y1": ("top_left_y", "h", "height_pt"), "x2": ("bottom_right_x", "w", "width_pt"), "y2": ("bottom_right_y", "h", "height_pt")}
    at = {k: G.round2(G.within(F.col(f"b.{c}").cast("double") * (F.col(page) / F.col(own)), F.lit(0.0), F.col(page))).alias(k) for k, (c, own, page) in sides.items()}
    b = b.select("service_page_id", "book_id", "page_index", "pos", kind.alias("type"), F.col("b.content").alias("raw"), *at.values())
    b = cut_lineage(b)  # the filter below would repeat every expression: too much code for one method
    content = F.when(F.col("type") == "image", F.lit("")).otherwise(F.coalesce(T.clean_content(F.col("type"), F.col("raw")), F.lit("")))
    b = b.withColumn("content", content).drop("raw")
    return b.filter((F.col("x2") - F.col("x1") >= LEAST_POINTS) & (F.col("y2") - F.col("y1") >= LEAST_POINTS) & ((F.col("type") == "image") | (F.col("content") != ""))), refused


def dedup(placed: DataFrame) -> DataFrame:
    """Placed blocks without readings that hold no words, near-duplicates folded into the fullest one, whose box grows."""
    placed = cut_lineage(placed)  # used twice
    family = F.col("type").isin(T.TEXT_FAMILY)
    keys = ["service_page_id", "book_id", "page_index"]
    own = placed.filter(family & T.has_words(F.col("content")) & ~T.is_placeholder(F.col("content"))).select(*keys, "pos", "type", "content", "x1", "y1", "x2", "y2", *T.features(F.col("content")))
    visit = F.struct((-F.col("norm_len")).alias("o1"), (-G.area(G.box())).alias("o2"), F.col("pos").alias("o3"), "pos", "type", "content", "x1", "y1", "x2", "y2", "norm", "norm_len", "toks", "tok_len", "grams", "heads")
    kept = own.groupBy(*keys).agg(F.collect_list(visit).alias("items")).select(*keys, F.explode(folds.dedup_text(F.col("items"), T.looks_dual)).alias("k"))
    out = ["pos", "type", "content", "x1", "y1", "x2", "y2"]
    kept = kept.select(*keys, "k.item.pos", "k.item.type", "k.item.content", "k.x1", "k.y1", "k.x2", "k.y2")
    return placed.filter(~family).select(*keys, *out).unionByName(kept)


def placed_blocks(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """The whole way: placed, typed, cleaned, de-duplicated blocks; tables with their grid's columns and rows."""
    b = dedup(place(pages, sizes)[0])
    grid = tables.parse_marks(F.when(F.col("type") == "table", F.col("content")))
    return b.withColumn("g", grid).select("*", F.col("g.cols").alias("grid_cols"), F.size("g.rows").alias("grid_rows")).drop("g")


def reconcile(requested: DataFrame, answered: DataFrame) -> DataFrame:
    """requested(batch, page_index 1-based), answered(batch, index) -> each requested page's answer under either numbering:
    a slice counts from 0 in the order asked, a whole document from 0 absolutely. status: ok, repeated request, answered
    twice, not covered. Pages that weren't asked for are ignored."""
    asked = requested.groupBy("batch", "page_index").agg(F.count("*").alias("times"))
    asked = asked.withColumn("rank", F.row_number().over(W.partitionBy("batch").orderBy("page_index")) - 1)
    got = answered.groupBy("batch", "index").agg(F.count("*").alias("answers"))
    of_got = got.groupBy("batch").agg(F.count("*").alias("n"), F.min("index").alias("low"), F.max("index").alias("high"), F.max("answers").alias("most"))
    of_asked = asked.groupBy("batch").agg(F.count("*").alias("wanted"), F.max("times").alias("asked_most"))
    j = asked.join(of_asked, "batch").join(of_got, "batch", "left")
    local = (F.col("n") == F.col("wanted")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)
    key = F.when(local, F.col("rank")).otherwise(F.col("page_index") - 1)
    j = j.withColumn("key", key.cast("int")).withColumn("local", F.coalesce(local, F.lit(False)))
    j = j.join(got.select("batch", F.col("index").alias("key"), F.lit(1).alias("there")), ["batch", "key"], "left")
    missing = F.max(F.col("there").isNull()).over(W.partitionBy("batch"))
    status = F.when(F.col("asked_most") > 1, "repeated request").when(F.col("most") > 1, "answered twice").when(missing, "not covered").otherwise("ok")
    return j.select("batch", "page_index", F.when(status == "ok", F.col("key")).alias("answer"), "local", status.alias("status"))


def as_service_page(regions: DataFrame, least_side: int = 0, most_images: int | None = None) -> DataFrame:
    """regions(page keys result_id, page, seq, label, x1..y2, markdown) -> blocks as the foreign protocol has them: coarser
    types, images numbered and limited, their text left out."""
    names = [x for p in NATIVE_TO_FOREIGN.items() for x in p]
    kind = F.coalesce(F.create_map(*map(F.lit, names))[F.col("label")], F.lit("text"))
    r = regions.withColumn("type", kind)
    image = F.col("type") == "image"
    r = r.filter(~image | (F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= least_side))
    r = r.withColumn("k", F.row_number().over(W.partitionBy("result_id", "type").orderBy("seq")) - 1)
    if most_images is not None:
        r = r.filter(~image | (F.col("k") < most_images))
    return r.select("result_id", "seq", "type", "label", F.when(image, F.concat(F.lit("img-"), "page", F.lit("-"), "k")).alias("image_id"), F.when(image, F.lit("")).otherwise(F.col("markdown")).alias("content"))

"""Order-dependent merges of one page's boxes. First-match folds run as one `aggregate` over the page's array, so a page is a
row and nothing leaves the JVM; the priority merge with its fixpoint changes earlier decisions and runs in Arrow batches of pages.

Arrays hold structs with x1, y1, x2, y2, label, score, origin, seq. Empty and null arrays give empty results; ties are
broken by seq."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagewright.functions import geom as G

BOX = ["x1", "y1", "x2", "y2", "label", "score", "origin", "seq"]
#: Labels that the recall passes may add; the tile pass may add the page's head and foot as well.
RECALL_LABELS = ["text", "paragraph_title", "doc_title", "abstract", "content", "reference", "reference_content", "footnote", "aside_text", "figure_title"]
TILE_LABELS = [*RECALL_LABELS, "header", "footer"]


#: By how many pixels a detection grows at each side.
GROW = 2.0


def page_arrays(boxes: DataFrame, *keys: str, columns: list[str] | None = None) -> DataFrame:
    """One row per page with its boxes as an array in order of seq."""
    names = columns or BOX
    rows = F.array_sort(F.collect_list(F.struct("seq", *[c for c in names if c != "seq"])))
    return boxes.groupBy(*keys).agg(rows.alias("boxes"))


def add_only(boxes: Column, iou_limit: float = 0.3, limit: float = 0.6) -> Column:
    """Main detections (origin 0) stay; a recall pass's box joins if its label is allowed and it neither overlaps a kept box
    nor lies in one (a figure doesn't keep text out by containing it)."""
    ordered = F.array_sort(boxes, lambda a, b: F.when(a["origin"] != b["origin"], a["origin"] - b["origin"]).otherwise(a["seq"] - b["seq"]).cast("int"))
    empty = F.filter(boxes, lambda _: F.lit(False))

    def step(kept: Column, c: Column) -> Column:
        hits = F.exists(kept, lambda k: (G.iou(c, k) > iou_limit) | (~(G.is_figure(k) & ~G.is_figure(c)) & (G.containment(c, k) > limit)))
        allowed = F.when(c["origin"] == 1, c["label"].isin(RECALL_LABELS)).otherwise(c["label"].isin(TILE_LABELS))
        return F.when((c["origin"] == 0) | (allowed & ~hits), F.concat(kept, F.array(c))).otherwise(kept)

    return F.aggregate(ordered, empty, step)


def group_lines(lines: Column, gap: float = 0.6, overlap: float = 0.3) -> Column:
    """Text lines to blocks: a line joins the first group whose foot is near enough and whose width it shares."""
    ordered = F.array_sort(F.transform(lines, lambda r: F.struct(r["y1"].alias("y1"), r["x1"].alias("x1"), r["y2"].alias("y2"), r["x2"].alias("x2"), (r["y2"] - r["y1"]).alias("h"))))
    empty = F.filter(ordered, lambda _: F.lit(False))

    def step(groups: Column, r: Column) -> Column:
        def fits(g: Column) -> Column:
            shared = G.at_least(F.least(g["x2"], r["x2"]) - F.greatest(g["x1"], r["x1"]))
            return ~(r["y1"] - g["y2"] > g["h"] * gap) & ~(shared < F.least(g["x2"] - g["x1"], r["x2"] - r["x1"]) * overlap)

        at = F.array_position(F.transform(groups, fits), F.lit(True))
        grown = F.transform(
            groups,
            lambda g, i: F.when(
                i + 1 == at,
                F.struct(F.least(g["y1"], r["y1"]).alias("y1"), F.least(g["x1"], r["x1"]).alias("x1"), F.greatest(g["y2"], r["y2"]).alias("y2"), F.greatest(g["x2"], r["x2"]).alias("x2"), F.greatest(g["h"], r["h"]).alias("h")),
            ).otherwise(g),
        )
        return F.when(at > 0, grown).otherwise(F.concat(groups, F.array(r)))

    return F.aggregate(ordered, empty, step)


def dedup_text(items: Column, similar, least_overlap: float = 0.15) -> Column:
    """Near-duplicate readings of one page: items (structs with x1..y2, text features, seq) are visited with the longest
    normal form first, then score, then area; each joins the first survivor that overlaps it, as grown so far, and that
    `similar(a, b)` holds for. Survivors carry `size`, the readings they stand for."""
    ordered = F.array_sort(items)
    empty = F.filter(F.transform(items, lambda i: F.struct(i.alias("item"), i["x1"].alias("x1"), i["y1"].alias("y1"), i["x2"].alias("x2"), i["y2"].alias("y2"), F.lit(1).alias("size"))), lambda _: F.lit(False))

    def step(kept: Column, c: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: (G.iom(k, c) >= least_overlap) & similar(k["item"], c)), F.lit(True))
        grown = F.transform(kept, lambda k, i: F.when(i + 1 == at, F.struct(k["item"].alias("item"), *(v.alias(n) for n, v in G.union(k, c).items()), (k["size"] + 1).alias("size"))).otherwise(k))
        fresh = F.struct(c.alias("item"), c["x1"].alias("x1"), c["y1"].alias("y1"), c["x2"].alias("x2"), c["y2"].alias("y2"), F.lit(1).alias("size"))
        return F.when(at > 0, grown).otherwise(F.concat(kept, F.array(fresh)))

    return F.aggregate(ordered, empty, step)


# -- priority merge with fixpoint ---------------------------------------------------------------------------------------


def detects_again(c: np.ndarray, kept: np.ndarray, c_kind: np.ndarray, kept_kind: int, iou_limit: float = 0.5, limits: tuple = (0.25, 0.35, 0.35)) -> np.ndarray:
    """Which of the boxes c (n x 4) detect the box `kept` again? Kinds: 0 structured, 1 figure, 2 other. Either they mostly are
    the same area, or the kept one holds enough of the other; but a figure keeps what is inside it and no figure."""
    both = np.prod(np.maximum(np.minimum(c[:, 2:], kept[2:]) - np.maximum(c[:, :2], kept[:2]), 0.0), axis=1)
    own, other = np.prod(c[:, 2:] - c[:, :2], axis=1), float(np.prod(kept[2:] - kept[:2]))
    share = lambda part, whole: np.divide(part, whole, out=np.zeros_like(part), where=whole > 0)
    inside = share(both, own) > limits[kept_kind]
    if kept_kind == 1:
        inside &= c_kind == 1
    return (share(both, own + other - both) > iou_limit) | inside


def _absorb(rect: np.ndarray, kind: np.ndarray, live: list[int], at: int) -> bool:
    """Let the kept box at this place take in those after it, the last that it absorbs first, as it grows; has any gone?"""
    end, gone = len(live), False
    while at + 1 < end:
        others = live[at + 1 : end]
        hits = np.flatnonzero(detects_again(rect[others], rect[live[at]], kind[others], int(kind[live[at]])))
        if not len(hits):
            break
        end = at + 1 + int(hits[-1])
        taken = live.pop(end)
        rect[live[at]] = np.concatenate([np.minimum(rect[live[at], :2], rect[taken, :2]), np.maximum(rect[live[at], 2:], rect[taken, 2:])])
        gone = True
    return gone


def merge_page(boxes: list[list]) -> list[list]:
    """boxes: [x1, y1, x2, y2, label, score, origin, seq]; kept boxes by falling score. By priority, each box joins the first
    kept one that it detects again; after every union all pairs are decided anew until none absorbs another."""
    if not boxes:
        return []
    kinds = {**dict.fromkeys(G.STRUCTURED, 0), **dict.fromkeys(G.FIGURES, 1)}
    rect, kind = np.array([b[:4] for b in boxes], dtype=float), np.array([kinds.get(b[4], 2) for b in boxes])
    area = np.prod(np.maximum(rect[:, 2:] - rect[:, :2], 0.0), axis=1)
    score, origin, seq = (np.array([b[k] for b in boxes], dtype=float) for k in (5, 6, 7))
    live: list[int] = []
    for i in np.lexsort((seq, -score, -area, origin, kind)).tolist():
        host = next((p for p, k in enumerate(live) if detects_again(rect[[i]], rect[k], kind[[i]], int(kind[k]))[0]), None)
        live.append(i)
        if host is not None:
            live.pop()
            k = live[host]
            rect[k] = np.concatenate([np.minimum(rect[k, :2], rect[i, :2]), np.maximum(rect[k, 2:], rect[i, 2:])])
            changed = True
            while changed:
                changed, at = False, 0
                while at < len(live):
                    changed |= _absorb(rect, kind, live, at)
                    at += 1
    return [[*rect[i].tolist(), *boxes[i][4:]] for i in sorted(live, key=lambda i: -boxes[i][5])]


def merge_boxes(boxes: DataFrame, *keys: str, least_score: float = 0.35, least_area: float = 256.0, most: int = 100, pixels: float = GROW, size: tuple[str, str] | None = None) -> DataFrame:
    """boxes(keys, x1..seq) -> the merged boxes of each page, the `most` best by score, with their place. Boxes grow by `pixels`
    and are cut to the page (whose width and height the columns `size` name) before anything is asked of them."""
    grown = boxes.withColumns(G.expand(G.box(), pixels))
    if size:
        grown = grown.withColumns(G.clamp(G.box(), F.col(size[0]).cast("double"), F.col(size[1]).cast("double")))
    fine = grown.filter((F.col("score") >= least_score) & (G.area(G.box()) >= least_area))
    pages = page_arrays(fine, *keys)
    schema = StructType([*boxes.select(*keys).schema.fields, *StructType.fromDDL("place int, x1 double, y1 double, x2 double, y2 double, label string, score double, origin int, seq bigint").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page in b.to_pylist():
                kept = merge_page([[x[c] for c in BOX] for x in page["boxes"]])[:most]
                rows += [{**{k: page[k] for k in keys}, "place": n, **dict(zip(BOX, k, strict=True))} for n, k in enumerate(kept)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return pages.mapInArrow(run, schema)

import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import geom as G
from pagewright.operators import folds


def box(spark, *rows):
    return spark.createDataFrame([tuple(map(float, a + b)) for a, b in rows], "ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double")


def test_measures_and_their_guards(spark):
    df = box(spark, ((0, 0, 10, 10), (5, 0, 15, 10)), ((0, 0, 0, 10), (0, 0, 10, 10)), ((0, 0, 1, 1), (5, 5, 6, 6)))
    a, b = ({c: F.col(f"{s}{c}") for c in ("x1", "y1", "x2", "y2")} for s in "ab")
    rows = df.select(G.iou(a, b), G.containment(a, b), G.iom(a, b)).collect()
    assert [tuple(r) for r in rows] == [(pytest.approx(1 / 3), 0.5, 0.5), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_rounding_and_clamping(spark):
    df = spark.createDataFrame([(1.005, 3.0), (float("nan"), 1.0), (2.675, 3.0)], "v double, s double")
    rows = df.select(G.round2(F.col("v")), G.to_points(F.col("s"), F.lit(2.0)), G.within(F.col("v"), F.lit(0.0), F.lit(2.0))).collect()
    assert rows[0][0] == 1.0 and rows[0][1] == 1.5 and rows[1][2] == 0.0 and rows[2][2] == 2.0


@pytest.mark.parametrize("overlap", [-0.2, 0.0, 0.08, 0.49, 1.0])
def test_tiles_leave_no_gap(spark, overlap):
    t = spark.createDataFrame([(1191, 1684), (100, 150)], "w int, h int").select(G.tiles(F.col("w"), F.col("h"), overlap).alias("t")).collect()
    top, bottom = t[0]["t"]
    assert t[1]["t"] == [] and top["y1"] == 0 and bottom["y2"] == 1684 and top["y2"] >= bottom["y1"] and bottom["y1"] > 0


def test_priority_merge_golden():
    row = lambda x1, y1, x2, y2, label="text", score=0.9, origin=0, seq=0: [x1, y1, x2, y2, label, score, origin, seq]
    # the second is taken in by the first, the union then covers the third
    kept = folds.merge_page([row(0, 0, 200, 100), row(90, 0, 300, 100, score=0.8, seq=1), row(190, 10, 300, 90, score=0.7, seq=2)])
    assert [k[:4] for k in kept] == [[0, 0, 300, 100]]
    figure = row(0, 0, 300, 300, "image")
    title = row(0, 0, 90, 300, "paragraph_title", seq=1)
    assert len(folds.merge_page([figure, title])) == 2
    assert folds.merge_page([]) == []


def random_boxes(rng, n):
    out = []
    for seq in range(n):
        x, y = rng.randrange(0, 200), rng.randrange(0, 200)
        out.append((float(x), float(y), float(x + rng.randrange(5, 90)), float(y + rng.randrange(5, 40)), rng.choice(["text", "table", "image", "footer"]), round(rng.random(), 3), rng.randrange(3), seq))
    return out


def test_priority_merge_loses_no_pixel():
    rng = random.Random(1)
    for _ in range(200):
        boxes = random_boxes(rng, rng.randrange(1, 14))
        kept = folds.merge_page([list(b) for b in boxes])
        assert all(any(k[0] <= b[0] and k[1] <= b[1] and k[2] >= b[2] and k[3] >= b[3] for k in kept) for b in boxes)
        assert sorted(k[7] for k in kept) == sorted(k[7] for k in brute_merge(boxes)) and sorted(k[:4] for k in kept) == sorted(k[:4] for k in brute_merge(boxes))


def brute_merge(boxes):
    """The same rule with one pair at a time."""

    def again(c, k):
        both = max(0, min(c[2], k[2]) - max(c[0], k[0])) * max(0, min(c[3], k[3]) - max(c[1], k[1]))
        a, b = ((r[2] - r[0]) * (r[3] - r[1]) for r in (c, k))
        if both / (a + b - both) > 0.5:
            return True
        return not (k[4] == "image" != c[4]) and both / a > (0.25 if k[4] == "table" else 0.35)

    join = lambda k, c: [min(k[0], c[0]), min(k[1], c[1]), max(k[2], c[2]), max(k[3], c[3]), *k[4:]]
    rank = {"table": 0, "image": 1}
    kept = []
    for b in sorted(map(list, boxes), key=lambda b: (rank.get(b[4], 2), b[6], -(b[2] - b[0]) * (b[3] - b[1]), -b[5], b[7])):
        for n, k in enumerate(kept):
            if again(b, k):
                kept[n] = join(k, b)
                break
        else:
            kept.append(b)
            continue
        before = -1
        while before != len(kept):
            before, i = len(kept), 0
            while i < len(kept):
                for j in range(len(kept) - 1, i, -1):
                    if again(kept[j], kept[i]):
                        kept[i] = join(kept[i], kept.pop(j))
                i += 1
    return kept


def test_boxes_grow_before_they_are_judged(spark):
    ddl = "page int, width int, height int, x1 double, y1 double, x2 double, y2 double, label string, score double, origin int, seq bigint"
    rows = [(1, 100, 100, 10.0, 10.0, 25.0, 25.0, "text", 0.9, 0, 0), (1, 100, 100, 90.0, 90.0, 99.0, 99.0, "text", 0.8, 0, 1)]
    got = folds.merge_boxes(spark.createDataFrame(rows, ddl), "page", size=("width", "height")).collect()
    assert [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in got] == [(8.0, 8.0, 27.0, 27.0)]  # 15 x 15 alone is too small; the other stays so at the page's edge


def brute_add_only(boxes):
    kept = []
    for b in sorted(boxes, key=lambda b: (b[6], b[7])):
        allowed = {0: [b[4]], 1: folds.RECALL_LABELS, 2: folds.TILE_LABELS}[b[6]]
        bad = False
        for k in kept if b[6] else []:
            both = max(0, min(b[2], k[2]) - max(b[0], k[0])) * max(0, min(b[3], k[3]) - max(b[1], k[1]))
            own, other = ((r[2] - r[0]) * (r[3] - r[1]) for r in (b, k))
            same, inside = both / (own + other - both), both / own
            if same > 0.3 or (not (k[4] in G.FIGURES and b[4] not in G.FIGURES) and inside > 0.6):
                bad = True
        if b[4] in allowed and not bad:
            kept.append(b)
    return sorted(b[7] for b in kept)


def brute_lines(boxes, gap=0.6, overlap=0.3):
    groups = []
    for x1, y1, x2, y2 in sorted((b[:4] for b in boxes), key=lambda r: (r[1], r[0], r[3], r[2])):
        for g in groups:
            shared = max(0, min(g[2], x2) - max(g[0], x1))
            if not (y1 - g[3] > gap * g[4]) and not (shared < overlap * min(g[2] - g[0], x2 - x1)):
                g[:] = [min(g[0], x1), min(g[1], y1), max(g[2], x2), max(g[3], y2), max(g[4], y2 - y1)]
                break
        else:
            groups.append([x1, y1, x2, y2, y2 - y1])
    return sorted(tuple(g[:4]) for g in groups)


def test_folds_equal_brute_force(spark):
    rng = random.Random(2)
    pages = {p: random_boxes(rng, rng.randrange(0, 12)) for p in range(120)}
    rows = [(p, *b) for p, bs in pages.items() for b in bs]
    df = spark.createDataFrame(rows, "page int, x1 double, y1 double, x2 double, y2 double, label string, score double, origin int, seq bigint")
    arrays = folds.page_arrays(df, "page")
    got = {r["page"]: r for r in arrays.select("page", F.transform(folds.add_only(F.col("boxes")), lambda b: b["seq"]).alias("k"), folds.group_lines(F.col("boxes")).alias("g")).collect()}
    for p, bs in pages.items():
        if bs:
            assert sorted(got[p]["k"]) == brute_add_only(bs)
            assert sorted((g["x1"], g["y1"], g["x2"], g["y2"]) for g in got[p]["g"]) == brute_lines(bs)
    merged = {}
    for r in folds.merge_boxes(df, "page", least_score=0.0, least_area=0.0, pixels=0.0).collect():
        merged.setdefault(r["page"], []).append((r["x1"], r["y1"], r["x2"], r["y2"], r["seq"]))
    for p, bs in pages.items():
        assert sorted(merged.get(p, [])) == sorted((*k[:4], k[7]) for k in folds.merge_page([list(b) for b in bs]))


def test_empty_pages(spark):
    df = spark.createDataFrame([], "page int, x1 double, y1 double, x2 double, y2 double, label string, score double, origin int, seq bigint")
    assert folds.page_arrays(df, "page").count() == 0 and folds.merge_boxes(df, "page").count() == 0

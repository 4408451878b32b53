import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import jobs, library, native, pages, protocol, tables, translation
from pagewright.plans import native as plans_native


def grid(spark, content, f=tables.parse_marks):
    g = spark.createDataFrame([(content,)], "c string").select(f(F.col("c")).alias("g")).first()["g"]
    return g and (g["cols"], [[(c["text"], c["colspan"]) for c in r["cells"]] for r in g["rows"]])


def test_marks(spark):
    assert grid(spark, "x<fcel>a<lcel><lcel><lcel><lcel><nl><fcel>b<fcel>c<ecel><fcel>d") == (5, [[("a", 5)], [("b", 1), ("c", 1), ("", 1), ("d", 1), ("", 1)]])
    assert grid(spark, "<lcel>gone<lcel><fcel> z ") == (3, [[("", 2), ("z", 1)]])
    assert grid(spark, "no marks") is None and grid(spark, "") is None and grid(spark, None) is None
    assert grid(spark, "<fcel>x" * 65) is None and grid(spark, "<fcel>x<nl>" * 201) is None
    assert grid(spark, "<fcel>x" * 64)[0] == 64


def test_html(spark):
    page = "<p>no</p><TABLE><tr><th colspan='2'>A&amp;B<td rowspan=2>x<br>y<tr><td>1<td><b>2</b></td></tr></table><table><tr><td>other</table>"
    assert grid(spark, page, tables.parse_any) == (3, [[("A&B", 2), ("x y", 1)], [("1", 1), ("2", 1), ("", 1)]])
    assert grid(spark, "<table></table>", tables.parse_any) is None
    assert grid(spark, "<fcel>m<td>", tables.parse_any) == (1, [[("m<td>", 1)]])


def test_matrices(spark):
    df = spark.createDataFrame([("<fcel>a<fcel>b<nl><fcel>c<fcel>d", v) for v in ('[["1", 2], ["x", null]]', '{"table": [["1", "2"], ["3", "4"]]}', '[["1"]]', '[["1", "2"], ["3"]]', "oops", None)], "c string, v string")
    got = [r[0] for r in df.select(tables.translated_matrix(F.col("v"), tables.parse_marks(F.col("c")))).collect()]
    assert got == [[["1", "2"], ["x", None]], [["1", "2"], ["3", "4"]], None, None, None, None]


@pytest.mark.parametrize(
    ("asked", "answered", "status", "keys"),
    [([3, 5], [0, 1], "ok", [0, 1]), ([3, 5], [2, 4], "ok", [2, 4]), ([1, 2], [0, 1], "ok", [0, 1]), ([3, 5], [2, 4, 9], "ok", [2, 4]), ([3, 5], [2], "not covered", [None, None]), ([3, 3], [0, 1], "repeated request", [None]), ([3, 5], [2, 4, 4], "answered twice", [None, None]), ([3], [], "not covered", [None])],
)
def test_page_numberings(spark, asked, answered, status, keys):
    a = spark.createDataFrame([("b", p) for p in asked], "batch string, page_index int")
    g = spark.createDataFrame([("b", i) for i in answered], "batch string, index int")
    rows = sorted(pages.reconcile(a, g).collect(), key=lambda r: r["page_index"])
    assert [r["answer"] for r in rows] == keys and {r["status"] for r in rows} == {status}


def test_placing_refuses_page_by_page(spark):
    block = "struct<type string, top_left_x int, top_left_y int, bottom_right_x int, bottom_right_y int, content string, label string, image_id string>"
    fine = [("text", 0, 0, 100, 50, "hello there", None, None), ("image", 0, 60, 100, 90, "x", None, None), ("text", 0, 0, 100, 0, "flat", None, None), ("text", 0, 100, 90, 120, " ", None, None)]
    rows = [(1, "b", 1, (0, 200, 400), fine), (2, "b", 2, (0, 400, 200), fine), (3, "b", 3, None, fine), (4, "b", 4, (0, 200, 400), None), (5, "b", 5, (0, 200, 400), [])]
    p = spark.createDataFrame(rows, f"service_page_id bigint, book_id string, page_index int, dimensions struct<dpi int, width int, height int>, blocks array<{block}>")
    s = spark.createDataFrame([("b", i, 100.0, 200.0) for i in range(1, 6)], "book_id string, page_index int, width_pt double, height_pt double")
    placed, refused = pages.place(p, s)
    assert {r["service_page_id"]: r["reason"] for r in refused.collect()} == {2: "other page box", 3: "no dimensions", 4: "no blocks"}
    assert sorted((r["pos"], r["type"], r["content"], r["x2"], r["y2"]) for r in placed.collect()) == [(0, "text", "hello there", 50.0, 25.0), (1, "image", "", 50.0, 45.0)]
    assert pages.placed_blocks(p, s).count() == 2


def test_phases_go_by_position(spark):
    p = spark.createDataFrame([("b", i) for i in (9, 2, 4, 4)], "book_id string, page_index int")
    assert sorted((r["page_index"], r["phase"]) for r in translation.phases(p).collect()) == [(2, 0), (4, 1), (9, 0)]


def test_replies(spark):
    raw = ['```json\n{"result":[{"index":0,"A":"x"},{"index":"1","content":"y"}]}\n```', '{"result":[{"A":"x"}]}', "words", '{"need_context":"before"}', None]
    df = spark.createDataFrame([("b", i, r) for i, r in enumerate(raw)], "book_id string, page_index int, raw string")
    got = {}
    for r in translation.parse_replies(df).collect():
        got.setdefault(r["page_index"], []).append((r["ok"], r["index"], r["value"], r["need_context"]))
    assert sorted(got[0]) == [(True, "0", "x", None), (True, "1", "y", None)]
    assert got[1] == got[2] == got[4] == [(False, None, None, None)] and got[3] == [(True, None, None, "before")]


def test_talk_with_a_model():
    answers = iter(["words", json.dumps({"need_context": "after"}), json.dumps({"result": [{"index": "0", "A": 1}]})])
    given = []
    assert protocol.talk(["0"], ["t"], {"after": ["next"]}, lambda r, c, n: given.append(c) or next(answers)) == ("done", 3, {"0": "1"}, None)
    assert given == [None, None, ["next"]]
    assert protocol.talk(["0"], ["t"], {}, lambda r, c, n: "{}")[0] == "mismatch"
    assert protocol.talk(["0"], ["t"], {}, lambda r, c, n: '{"need_context": "before"}')[:2] == ("context again", 4)


def test_a_reply_that_asks_is_a_request_and_tables_keep_their_shape():
    both = json.dumps({"need_context": "before", "result": [{"index": 0, "A": "x"}]})
    answers = iter([both, json.dumps({"result": [{"index": 0, "A": "y"}], "external_index": "1", "external": "z"})])
    assert protocol.talk(["0"], ["t"], {"before": ["a", "b"]}, lambda r, c, n: next(answers)) == ("done", 2, {"0": "y"}, ("before", 1, "z"))
    table = json.dumps({"table": [["a", "b"], ["c"]]})
    reply = lambda rows: (lambda r, c, n: json.dumps({"result": [{"index": "0", "A": json.dumps(rows)}]}))
    assert protocol.talk(["0"], [table], {}, reply([["A", 1], [None]]), [True])[2] == {"0": '[["A","1"],[null]]'}
    assert protocol.talk(["0"], [table], {}, reply({"table": [["A", "B"], ["C"]]}), [True])[0] == "done"
    for wrong in ([["A"], ["C"]], [["A", "B"]], [["A", ["B"]], ["C"]], "A"):
        assert protocol.talk(["0"], [table], {}, reply(wrong), [True])[0] == "mismatch"
    assert protocol.external({"external_index": 2, "external": "z"}, ["a", "b"]) is None


def test_replies_apply_only_where_valid(spark):
    b = spark.createDataFrame([("b", 1, 0, "text", "one", None), ("b", 1, 1, "text", "two", None), ("b", 2, 0, "text", "one", None), ("b", 3, 0, "table", "<fcel>a<fcel>b<nl>", None), ("b", 4, 0, "table", "<fcel>a<nl>", None)], "book_id string, page_index int, block_pos int, type string, content string, translation string")
    p = spark.createDataFrame([("b", i, True, None) for i in (1, 2, 3, 4)], "book_id string, page_index int, finished boolean, translated boolean")
    raw = {1: '{"result":[{"index":0,"A":"eins"}]}', 2: '{"result":[{"index":"0","content":"eins"}]}', 3: '{"result":[{"index":0,"A":[["x","y"]]}]}', 4: '{"result":[{"index":0,"A":"[[1,2]]"}]}'}
    items = translation.parse_replies(spark.createDataFrame([("b", k, v) for k, v in raw.items()], "book_id string, page_index int, raw string"))
    got = {(r["page_index"], r["block_pos"]): (r["translation"], r["grid"] is not None) for r in translation.apply_values(b, translation.requests(b, p), items).collect()}
    assert got == {(1, 0): (None, False), (1, 1): (None, False), (2, 0): ("eins", False), (3, 0): ('[["x","y"]]', True), (4, 0): (None, False)}


def test_spread_equals_brute_force():
    rng = np.random.default_rng(1)
    mask = rng.random((12, 40)) < 0.04
    want = np.zeros_like(mask)
    for y, x in zip(*np.nonzero(mask), strict=True):  # what is under the element when it is centred, the anchor at its half
        want[max(0, y - 1) : y + 2, max(0, x - 8) : x + 10] = True
    assert (native.spread(mask, 18, 3) == want).all()
    with_gap = np.zeros((60, 80), bool)
    with_gap[10:18, 10:60:2] = with_gap[19:27, 10:60:2] = True  # one line in two rows, a pixel apart
    assert len(native.text_lines(with_gap)) == 1


def test_strikes_and_ring(spark):
    df = spark.createDataFrame([(i, "b", "ocr", ok) for i, ok in enumerate([False, False, True, False, False, False])], "seq int, book_id string, kind string, ok boolean")
    assert [r["strikes"] for r in jobs.strikes(df).orderBy("seq").collect()] == [1, 2, 0, 1, 2, 3]
    p = spark.createDataFrame([("b", i) for i in range(1, 6)], "book_id string, page_index int")
    assert [r["page_index"] for r in jobs.ring(p, F.lit(4), 3).orderBy("place").collect()] == [4, 5, 1]


def test_library_rules(spark):
    names = spark.createDataFrame([(" ok ",), ("",), ("x" * 65,), ("a/b",), ("..",)], "n string")
    assert [r[0] for r in names.select(library.folder_error(F.col("n"))).collect()] == [None, "empty", "too long", "separator", "reserved"]
    files = spark.createDataFrame([("a.pdf", "A", b"1"), ("b.PDF", "B", b"1"), ("c.txt", "C", b"2"), ("d.pdf", " ", b"3")], "path string, name string, content binary")
    none = spark.createDataFrame([], "id string")
    got = {r["path"]: r["outcome"] for r in library.import_books(files, none).collect()}
    assert got == {"a.pdf": "imported", "b.PDF": "already there", "c.txt": "not a pdf", "d.pdf": "no name"}
    with pytest.raises(Exception, match="too many pages"):
        library.skeleton(spark.createDataFrame([("b", 20001)], "id string, pages int")).collect()


def test_ink():
    ink = np.zeros((400, 600), bool)
    ink[100:120, 50:300] = True
    assert native.trim_to_ink([[20.0, 60.0, 500.0, 300.0]], ink) == [[44.0, 94.0, 306.0, 126.0]]
    speck = np.zeros((400, 600), bool)
    speck[100, 100] = True
    assert native.trim_to_ink([[0.0, 0.0, 500.0, 300.0], [3.0, 3.0, 4.0, 9.0]], speck) == [[0.0, 0.0, 500.0, 300.0], [3.0, 3.0, 4.0, 9.0]]
    hatched = native.draw((400, 600), [[50, 100, 300, 130], [50, 200, 55, 230]])
    assert [b[1::2] for b in native.text_lines(hatched)] == [(99, 131)]  # spread by a pixel up and down
    gray = np.full((50, 50), 250, np.uint8)
    gray[10:20, 10:40] = 10
    assert native.ink_mask(gray).sum() == 300
    rng = np.random.default_rng(0)
    mask = rng.random((40, 40)) < 0.35
    assert native.components(mask) == flood(mask)


def flood(mask):
    seen, out = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        todo, seen[y, x], part = [(y, x)], True, []
        while todo:
            a, b = todo.pop()
            part.append((a, b))
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    c, d = a + i, b + j
                    if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        todo.append((c, d))
        ys, xs = zip(*part, strict=True)
        out.append((int(min(xs)), int(min(ys)), int(max(xs)) + 1, int(max(ys)) + 1))
    return sorted(out, key=lambda b: (b[1], b[0]))


def test_regions_add_up():
    items = [(0, "text", 0.9, [0, 0, 10, 10], "Hello big world"), (1, "text", 0.8, [1, 1, 11, 11], "hello big world!"), (2, "text", 0.5, [50, 50, 60, 60], "..."), (3, "table", 0.5, [0, 0, 10, 10], "."), (4, "text", 0.5, [0, 0, 9, 9], "[N/A]")]
    out = {r[0]: r[1:3] for r in native.resolve_regions(items)}
    assert out == {0: ("kept", None), 1: ("merged", 0), 2: ("junk", None), 3: ("kept", None), 4: ("junk", None)}


def random_masks(seed):
    rng = np.random.default_rng(seed)
    for k in range(120):
        mask = rng.random(rng.integers(1, 60, 2)) < rng.choice([0, 0.03, 0.3, 0.8, 1])
        yield rng, np.repeat(mask, 1 + k % 3, axis=0)


def test_ink_of_bands_equals_brute_force():
    for rng, mask in random_masks(2):
        (h, w), page = mask.shape, native.Bands.of(mask)
        assert (page.mask() == mask).all()
        x, y = (np.sort(rng.integers(0, n + 1, (9, 2)), axis=1) for n in (w, h))
        for x1, x2, y1, y2 in np.hstack([x, y]).tolist():
            at = [(b, a) for a in range(y1, y2) for b in range(x1, x2) if mask[a, b]]
            want = [min(a for a, _ in at), min(b for _, b in at), max(a for a, _ in at) + 1, max(b for _, b in at) + 1] if at else [x1, y1, x1, y1]
            assert native.ink_bounds(page, np.array([[x1, y1, x2, y2]])).tolist() == [want]
        boxes = (rng.random((5, 4)) * 90 - 20).tolist()
        assert (native.draw_bands((h, w), boxes).mask() == native.draw((h, w), boxes)).all()


def test_pages_are_dealt_out_to_tasks(spark):
    assert plans_native._rasters(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 4


def test_lines_of_bands_equal_brute_force():
    for rng, mask in random_masks(3):
        (h, w), page = mask.shape, native.Bands.of(mask)
        width, height = map(int, rng.integers(1, 9, 2))
        want = np.zeros_like(mask)
        for y, x in zip(*np.nonzero(mask), strict=True):
            want[max(0, y - (height - 1 - height // 2)) : y + height // 2 + 1, max(0, x - (width - 1 - width // 2)) : x + width // 2 + 1] = True
        assert (native.spread_bands(page, width, height).mask() == want).all()
        assert native.components(page) == flood(mask)
        lines = [b for b in flood(native.spread(mask, 3, 3)) if b[3] - b[1] >= 2 and b[2] - b[0] >= 4 and 0.1 <= mask[b[1] : b[3], b[0] : b[2]].mean() <= 0.6]
        assert native.text_lines(page, 3, (2, 999), 4, (0.1, 0.6)) == lines

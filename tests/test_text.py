import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import folds, native
from pagewright.sources.requests import parse_page_filter, select_document


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c"))).first()[0]


def test_normal_forms(spark):
    assert one(spark, "Hello, Wörld 42!", T.normalized) == "hellowörld42"
    assert one(spark, "กิ हि", T.normalized) == "กह"
    assert one(spark, "กิ हि", lambda c: T.normalized(c, "foreign")) == "กิहि"
    assert one(spark, None, T.normalized) is None
    assert one(spark, "　 a \n", T.trim) == "a"
    assert one(spark, "[N/A]", T.is_placeholder) and not one(spark, "na na", T.is_placeholder)
    assert one(spark, "a", T.has_words) is False and one(spark, "", T.has_words) is False


@pytest.mark.parametrize(
    ("a", "b", "dual"),
    [("3", "31", False), ("", "x", False), ("The same text", "the SAME text.", True), ("A longer heading of the page", "A longer heading of the", True), ("connotation of the words here", "connota of the words here", True), ("alpha beta gamma delta", "one two three four", False)],
)
def test_two_readings(spark, a, b, dual):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = df.select(F.struct(*T.features(F.col("a"))).alias("a"), F.struct(*T.features(F.col("b"))).alias("b"))
    assert df.select(T.looks_dual(F.col("a"), F.col("b"))).first()[0] is dual
    assert native.dual(native.Reading(a), native.Reading(b)) is dual


def test_dice_and_ratio(spark):
    df = spark.createDataFrame([("night", "nacht"), ("a", "a"), ("a", "b"), ("aaaa", "aa")], "a string, b string")
    assert [r[0] for r in df.select(T.dice(F.col("a"), F.col("b"))).collect()] == [0.25, 1.0, 0.0, 0.5]
    r = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "x")], "a string, b string").select(native.ratio("a", "b")).collect()
    assert [x[0] for x in r] == [0.25, 0.5, None]


def test_clean_and_types(spark):
    df = spark.createDataFrame([("doc_title", "# A <center>b</center>\r\n\n\n\nc "), ("formula", "x^2"), ("formula", "$x^2$"), ("formula", "plain words"), ("text", None)], "k string, c string")
    got = [r[0] for r in df.select(T.clean_content(F.col("k"), F.col("c"))).collect()]
    assert got == ["A b\n\nc", "$$x^2$$", "$x^2$", "plain words", None]
    assert [one(spark, x, T.map_type) for x in ("Sub Title", "page-number", "whatever", "figure")] == ["paragraph_title", "number", "text", "image"]


def test_small_formats(spark):
    assert one(spark, " host:80// ", T.normalize_url) == "http://host:80" and one(spark, "file:///x", T.normalize_url) is None and one(spark, " / ", T.normalize_url) is None
    assert one(spark, "http://[::1]:9055/x", T.is_loopback) and one(spark, "http://u@localhost:1", T.is_loopback) and not one(spark, "http://localhost.example", T.is_loopback)
    for a, b, gt in (("v1.2.10", "1.2.9", True), ("1.2", "1.2.0", False), ("1.2-beta", "1.2", False), ("2", "10", False)):
        assert spark.createDataFrame([(a, b)], "a string, b string").select(T.version_gt(F.col("a"), F.col("b"))).first()[0] is gt
    assert one(spark, '```json\n{"a": 1}\n```', T.extract_json) == '{"a": 1}' and one(spark, "no", T.extract_json) is None
    assert one(spark, '{"error": {"message": "m"}}', T.error_message) == "m" and one(spark, "x" * 400, T.error_message) == "x" * 300
    assert one(spark, "data:image/png;base64,YWI=", lambda c: F.decode(T.decode_data_uri(c), "utf-8")) == "ab" and one(spark, "%%%", T.decode_data_uri) is None


@pytest.mark.parametrize(("raw", "pages", "error"), [(None, [0, 1, 2, 3, 4], None), ("0,2-4", [0, 2, 3, 4], None), (" 3 , 1,1 ", [1, 3], None), ("-1", None, "malformed"), ("4-2", None, "malformed"), (",", None, "no page"), ("5", None, "out of range"), ("a", None, "malformed")])
def test_page_filter(spark, raw, pages, error):
    r = spark.createDataFrame([(raw, 5)], "r string, n int").select(parse_page_filter(F.col("r"), F.col("n")).alias("p")).first()["p"]
    assert r["error"] == error and r["pages"] == pages


def test_select_document(spark):
    df = spark.createDataFrame([(("document_url", "data:x", None),), (("image_url", None, "HTTPS://x"),), (("file", None, None),), (("image_url", None, None),)], "d struct<type string, document_url string, image_url string>")
    assert [r[0] for r in df.select(select_document(F.col("d"))).collect()] == ["data uri", "remote url refused", "unsupported", "missing"]


def test_dedup_fold_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    pages = {}
    for p in range(60):
        pages[p] = [(s, float(rng.randrange(60)), float(rng.randrange(60)), 100.0, 100.0, " ".join(rng.choices(words, k=rng.randrange(2, 6)))) for s in range(rng.randrange(1, 7))]
    rows = [(p, *b) for p, bs in pages.items() for b in bs]
    df = spark.createDataFrame(rows, "page int, seq int, x1 double, y1 double, x2 double, y2 double, c string")
    df = df.select("*", *T.features(F.col("c")))
    item = F.struct((-F.col("norm_len")).alias("o"), "seq", "x1", "y1", "x2", "y2", "norm", "norm_len", "toks", "tok_len", "grams", "heads")
    kept = df.groupBy("page").agg(F.collect_list(item).alias("i")).select("page", F.explode(folds.dedup_text(F.col("i"), T.looks_dual)).alias("k")).select("page", "k.item.seq", "k.x1", "k.y1", "k.size").collect()
    got = {}
    for r in kept:
        got.setdefault(r["page"], []).append((r["seq"], r["x1"], r["y1"], r["size"]))
    pairs = {}
    for p, bs in pages.items():
        out = []
        for b in sorted(bs, key=lambda b: (-len(native.normal(b[5])), b[0])):
            for s in out:
                if native._iom(s[1], list(b[1:5])) >= 0.15 and foreign_dual(spark, pairs, s[2], b[5]):
                    s[1][:] = [min(s[1][0], b[1]), min(s[1][1], b[2]), 100.0, 100.0]
                    s[3] += 1
                    break
            else:
                out.append([b[0], list(b[1:5]), b[5], 1])
        assert sorted(got[p]) == sorted((s[0], s[1][0], s[1][1], s[3]) for s in out)


def foreign_dual(spark, known, a, b):
    """The rule once more, in plain Python."""
    import re
    from collections import Counter

    x, y = native.normal(a), native.normal(b)
    if not x or not y:
        return False
    short, long = sorted((x, y), key=len)
    if x == y or (len(short) >= 8 and short in long):
        return True
    s, t = (re.findall("[0-9a-z]+", v.lower()) for v in (a, b))
    few, many = (s, t) if len(s) <= len(t) else (t, s)
    heads = {w[:4] for w in many if len(w) >= 4}
    hits = sum(w in many or (len(w) >= 4 and w[:4] in heads) for w in few)
    if few and hits / len(few) >= 0.7 and min(sum(map(len, s)) / len(x), sum(map(len, t)) / len(y)) >= 0.6 and (len(few) >= 3 or (hits == len(few) and len(short) >= 8)):
        return True
    g, h = (Counter(v[i : i + 2] for i in range(len(v) - 1)) for v in (x, y))
    total = sum(g.values()) + sum(h.values())
    return (2 * sum((g & h).values()) / total if total else float(x == y)) >= 0.82

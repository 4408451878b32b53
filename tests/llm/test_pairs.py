import random

import pytest

from pagewright.llm import p1_pairs as P

NAMES = ["Tavorel", "Beranik", "Sodalym", "Kafelon", "Mirosan", "Dolareth", "Wapelin", "Gotarus", "Hekelya", "Nafaril"]
LANGS = {
    "en": ["The {a} near {n} was measured {d} times.", "Nobody in {n} could explain the {a} of week {d}.", "For every {d} sheets, {n} staff clean the {a} with care."],
    "de": ["Bei {n} wurde {a} genau {d} Mal gemessen.", "Niemand in {n} konnte {a} der Woche {d} erklären.", "Nach je {d} Blatt reinigen die Leute von {n} sorgfältig {a}."],
    "zh": ["在 {n} 附近{a}被测量了 {d} 次。", "{n} 没有人能解释第 {d} 周的{a}。", "每 {d} 张纸之后，{n} 的人员仔细清洁{a}。"],
}
THINGS = {"en": ["water sample", "paper feed", "wall panel"], "de": ["die Wasserprobe", "den Papiereinzug", "die Wandplatte"], "zh": ["水样", "进纸机构", "墙板"]}


def sentences(rng, n):
    return [(rng.randrange(3), rng.randrange(3), rng.choice(NAMES) + rng.choice("abcde"), rng.randrange(10, 900)) for _ in range(n)]


def render(lang, parts):
    return ("" if lang == "zh" else " ").join(LANGS[lang][t].format(a=THINGS[lang][k], n=n, d=d) for t, k, n, d in parts)


@pytest.fixture(scope="module")
def data(spark, blocks_of):
    rng = random.Random(4)
    rows, pages, truth = [], [], {}
    for i in range(700):
        src, dst = rng.sample(list(LANGS), 2)
        parts = sentences(rng, rng.randrange(1, 5))
        x, y, kind = render(src, parts), render(dst, parts), None
        if i % 10 == 0:
            kind = rng.choice(["empty", "copied", "refusal", "truncated", "wrong_language"])
            third = next(k for k in LANGS if k not in (src, dst))
            y = {"empty": rng.choice(["", " \n", "null", "{}"]), "copied": "A: " + x.upper(), "refusal": "I'm sorry, but I can't translate this passage.", "truncated": y[: len(y) // 2].rstrip(" ."), "wrong_language": render(third, parts)}[kind]
        elif i % 10 == 1:
            x, y = x + "\n© 2020 House, all rights held", y + "\n© 2020 House, all rights held"
        rows.append((i, "b", i, 0, "text", x, y))
        pages.append(("b", i, dst))
        if kind:
            truth[i] = kind
    extra = [(1000, "b", 0, 1, "text", "KX-4432", "KX-4432"), (1001, "b", 0, 2, "text", None, "x"), (1002, "b", 0, 3, "text", "Some text here.", None), (1003, "c", 9, 0, "text", "No page asks for a language here.", ""), (1004, "b", 0, 4, "table", "<fcel>a", "")]
    df = blocks_of(rows + extra)
    return df.union(df.limit(40)), spark.createDataFrame(pages, "book_id string, page_index int, target_lang string"), truth | {1003: "empty"}


def test_held_out_defects(data):
    blocks, pages, truth = data
    got = {r["block_id"]: r["defect"] for r in P.defects(blocks.filter("type <> 'table'"), pages, sample=400).collect()}
    right = sum(got.get(k) == v for k, v in truth.items())
    wrong = [k for k in got if k not in truth]
    assert right >= 0.9 * len(truth) and len(wrong) <= 8
    assert 1000 not in got and 1001 not in got and 1002 not in got


def test_few_pairs_only_find_empty_ones(spark, blocks_of):
    pages = spark.createDataFrame([("b", 1, "en")], "book_id string, page_index int, target_lang string")
    rows = P.defects(blocks_of([(1, "b", 1, 0, "text", "x y", "-"), (2, "b", 1, 1, "text", "x y", "good")]), pages).collect()
    assert [(r["block_id"], r["defect"]) for r in rows] == [(1, "empty")]


def test_parts():
    assert P.is_code("JD-8707") and P.is_code("12 of 40") is False and P.is_code("12.5") and not P.is_code("Plan JD-1")
    assert not P.has_text(" “” ") and not P.has_text("N/A") and P.has_text("no")
    assert P.own_lines("a b\nnotice", "c d\nnotice") == ("a b", "c d") and P.own_lines("notice", "notice") == ("notice", "notice")
    assert len(P.features("x", "y", frozenset())) == len(P.FEATURES)
    long = "word " * 200_000
    assert len(P.features(long, long, frozenset())) == len(P.FEATURES)

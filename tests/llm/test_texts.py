import itertools
import random
import re

from pyspark.sql import functions as F

from pagewright.llm import p2_residue as R
from pagewright.llm import p3_scan as S
from pagewright.llm import p4_lines as L
from pagewright.llm import p5_cut as C

SENTENCES = ["The water sample near {n} was compared with the paper feed for {d} days.", "Nobody in {n} could explain why the wall panel outlasted the side note by {d} hours.", "For every {d} sheets, {n} assistants clean the storage hall, then realign the index card.", "Because the mixing tank ran warm, {n} staff closed the lower shelf at step {d}.", "Around {d} readers asked {n} whether the book spine belongs before the test protocol."]


def prose(rng, n):
    name = lambda: rng.choice("BDFGKLMNPRST") + "".join(rng.choice(["ar", "el", "os", "an"]) + rng.choice("bdfklmnprt") for _ in range(3)) + "a"
    return " ".join(rng.choice(SENTENCES).format(n=name(), d=rng.randrange(1000)) for _ in range(n))


# -- 2 ------------------------------------------------------------------------------------------------------------------


def test_residue_rules():
    found = ["Dear {{ first_name }}, hello", "see <%= unit %> there", "%title%", "__issueNo__", "Hi [Your name]", "[INSERT DATE HERE]", "*|FNAME|*", "the @Model.Date is", "«author_name» wrote", "HTTP 503 Service Unavailable", "Please enable JavaScript to go on.", "404 - page not found", "Lorem ipsum dolor sit amet consectetur", "asdf asdf qwer", "xxxxx xxxx xxxxx", "ПОЖАЛУЙСТА, ВКЛЮЧИТЕ JAVASCRIPT."]
    fine = ["", "Section 4 describes how JavaScript draws a page.", "He paid 100% of 5% tax", "a set {1, 2}", "x_{i} and \\frac{a}{b}", "«Лоток» стоит", "error 404 explained in the help page", "The server was polite.", "array[i] = [3]", "a < b and c > d", "snake_case_name"]
    found += ["第%unit%页", "见__QUANTITY__Kelora", "管道{chapter_title}之后", "«author_name» wrote " + "and then some more. " * 500]
    assert [t for t in found if not R.messages(t)] == [] and [t for t in fine if any(sure for _, sure in R.messages(t))] == []
    same = ["Error 404: /doc/17 on 2020-01-02", "ERROR 500: /x/9 on 2021-11-12", "<p>Error 7: /doc/1 on 3.4.2020</p>"]
    assert len({R.normal(R.masked(t)) for t in same}) == 1
    assert R.normal(R.masked("Notice: Page not found")) == R.normal(R.masked("page NOT found."))
    assert R.messages("word " * 100_000) == []


def test_messages_must_recur_over_sources(spark):
    row = lambda i, source, text: ("block", i, 0, source, text)
    said = "It was a long day and a long walk, with much to see on the way. The page was not found. " + "Then they went on and on, over hills and far away, as people do who have the time. " * 2
    rows = [row(1, "a", said), row(2, "b", said.replace("a long day", "one day")), row(3, "c", said.replace("The page was not found", "The page on Berlin was not found")), row(4, "a", None), row(5, "a", ""), row(6, "c", "Notice: The page was not found"), row(6, "c", "Notice: The page was not found")]
    rows += [row(10 + i, f"s{i}", f"Please enable JavaScript to read chapter {i}.") for i in range(5)]  # alone on its line, in many sources
    rows += [row(20 + i, "a", "Please enable JavaScript to print the map.") for i in range(5)]  # its twin, alone on its line as well, in one
    rows += [row(30, "a", "Dear {{ name }},"), row(31, "b", "Lorem ipsum dolor sit amet consectetur")]  # placeholders, in one each
    rows += [row(40 + i, f"s{i}", "JavaScript is disabled.\nEnable it and reload the page.") for i in range(3)]
    df = spark.createDataFrame(rows, "record_kind string, record_id bigint, block_pos int, source string, content string").withColumn("message", F.lit("clash"))
    got = {(r["record_id"], r["rule"]) for r in R.residue(df).collect()}
    assert got == {(i, "recurring") for i in (1, 2, 6, 10, 11, 12, 13, 14, 40, 41, 42)} | {(30, "placeholder"), (31, "placeholder")}


# -- 3 ------------------------------------------------------------------------------------------------------------------


def scan_tables(spark, blocks_of, tables):
    rng = random.Random(5)
    rows = [(i, "b", i, 1, "text", prose(rng, 3)) for i in range(400)]
    rows += [(1000 + p, "b", p, 0, "header", "Annals of Kelor") for p in range(0, 400, 10)] + [(2000 + p, "b", p, 9, "number", f"- {p + 4} -") for p in range(0, 400, 7)]
    noise = [
        (5000, "b", 500, 0, "text", "The watcr sample near Kobela was cornpared with the paper feed for 9 days."),
        (5001, "b", 501, 0, "text", "Nobody in Kodela could explain why the wall pa-\nnel outlasted the side note by 4 hours."),
        (5002, "b", 502, 0, "text", "* ANNALS  OF KELOR 12"),
        (5003, "b", 503, 0, "text", "The water sample near\n- 507 -\nKobela was compared with the paper feed for 8 days."),
        (5004, "b", 504, 0, "text", "The water sample\nnear Kobela was compared with\nthe paper feed for 8 days."),
        (5005, "b", 505, 0, "text", "- 12 -"),
        (5006, "b", 506, 0, "text", ""),
        (5007, "b", 507, 0, "text", None),
        (5008, "b", 508, 0, "footnote", "The watcr sample"),
    ]
    df = blocks_of(rows + noise)
    return tables(blocks=df.union(df.filter("block_id = 5000")))


def test_scan_noise_and_repair(spark, blocks_of, tables):
    d = scan_tables(spark, blocks_of, tables)
    got = {(r["record_id"], r["noise"]) for r in S.p3_found(spark, d).collect()}
    assert got == {(5000, "misread"), (5001, "hyphenation"), (5002, "running_header"), (5003, "page_number")}
    text = {r["record_id"]: r["text"] for r in S.p3_repaired(spark, d).collect()}
    assert text[5000] == "The water sample near Kobela was compared with the paper feed for 9 days."
    assert text[5001] == "Nobody in Kodela could explain why the wall panel outlasted the side note by 4 hours."
    assert text[5002] == "" and text[5003] == "The water sample near Kobela was compared with the paper feed for 8 days."


def test_odd_glyphs_in_words_without_a_vector(spark):
    rng = random.Random(11)
    rows = [("block", i, f"{prose(rng, 2)} " + ("See the handbook here." if i % 60 == 0 else "")) for i in range(600)]
    rows += [("block", 9000, "See the Handb0ok here."), ("block", 9001, "Part ab12cd of x9y."), ("block", 9002, None), ("block", 9003, "")]
    r = spark.createDataFrame(rows, "record_kind string, record_id bigint, text string")
    reader = S.Reader(r)
    keep = reader.spelling.index("handbook") if "handbook" in reader.spelling else -1
    if keep >= 0:  # as in a corpus where the word is too rare for a vector
        reader.words, reader.skeleton, reader.lead = reader.words[:0], reader.skeleton[:0], reader.lead[:0]
    got = [tuple(x) for x in S.odd_links(r, lambda: reader).collect()]
    assert got == [("block", 9000, "handb0ok", "handbook")]
    assert S.repair("See the Handb0ok here.", set(), reader, {"handb0ok": "handbook"}) == "See the Handbook here."


def test_skip_gram_vectors_tell_contexts():
    import numpy as np

    rng = np.random.default_rng(1)
    a = np.concatenate([rng.integers(0, 5, 4000), rng.integers(10, 15, 4000)])
    b = np.concatenate([rng.integers(5, 10, 4000), rng.integers(15, 20, 4000)])
    k, n = np.unique(a * 20 + b, return_counts=True)
    u, v = S.skip_gram(k // 20, k % 20, n, 20, dims=8, steps=120, draw=1024)
    fit = u @ v.T
    assert fit[:5, 5:10].mean() > fit[:5, 15:20].mean() + 0.5


# -- 4 ------------------------------------------------------------------------------------------------------------------


def test_prefix_span_equals_brute_force(spark, blocks_of):
    rng = random.Random(6)
    rows, n = [], 0
    for book in "ab":
        for page in range(14):
            for pos in range(3):
                n += 1
                rows.append((n, book, page, pos, rng.choice(["text", "footer", "table"]), "\n".join(rng.choice(["Join us!", "join, us 7", "All rights", "42", "", "x" * 3, "Über  uns"]) for _ in range(rng.randrange(1, 4)))))
    rows.append((n + 1, "a", 1, 9, "text", None))
    df = blocks_of(rows)
    patterns, _ = L.prefix_span(df.union(df.limit(5)), min_pages=5, max_length=3)
    seq = {}
    for _, book, page, _, kind, text in (r[:6] for r in rows):
        if text is not None and kind != "table":
            seq.setdefault((book, page), []).extend(x for x in (re.sub(r"[\W\d_]", "", t.lower()) for t in text.split("\n")) if x)
    expected = {}
    for (book, _), lines in seq.items():
        for k in (1, 2, 3):
            for p in set(itertools.combinations(lines, k)):
                expected[book, p] = expected.get((book, p), 0) + 1
    expected = sorted((book, len(p), n) for (book, p), n in expected.items() if n >= 5)
    ids = {r["h"]: r["book_id"] for r in spark.createDataFrame([("a",), ("b",)], "book_id string").select("book_id", F.xxhash64("book_id").alias("h")).collect()}
    assert sorted((ids[r["book"]], len(r["items"]), r["pages"]) for r in patterns.collect()) == expected


def test_sequences_of_any_length(spark, blocks_of):
    lines = ["Alpha", "Beta", "Gamma", "Delta", "Epsilon"]
    df = blocks_of([(10 * page + i, "a", page, i, "text", x) for page in range(6) for i, x in enumerate(lines)])
    patterns, _ = L.prefix_span(df)
    assert sorted(len(r["items"]) for r in patterns.collect()) == sorted(k for k in range(1, 6) for _ in itertools.combinations(lines, k))


# -- 5 ------------------------------------------------------------------------------------------------------------------


def test_cut_texts(spark, blocks_of):
    rng = random.Random(7)
    rows = [(i, "b", i, 0, "text", prose(rng, 4)) for i in range(600)]
    rows += [(1000 + i, "b", i, 1, "text", f"Tell a friend about {rng.choice(['Kelora', 'Dosana', 'Pelara'])}") for i in range(200)]
    rows += [(2000 + i, "b", i, 5, "text", f"KD-{1000 + i}") for i in range(100)]
    whole = prose(rng, 2)
    extra = [
        (5000, "c", 1, 0, "text", whole[:-9]), (5001, "c", 1, 1, "text", prose(rng, 1)), (5002, "c", 3, 0, "text", "Nobody in Kelora could explain why the wall"), (5003, "c", 4, 0, "text", "panel outlasted the side note by 12 hours."),
        (5004, "c", 6, 0, "text", "Nobody in Kelora could explain why the wall"), (5005, "c", 6, 1, "formula", "x=1"), (5006, "c", 8, 0, "text", prose(rng, 1) + " Around 12 readers asked Kel [cut]"), (5007, "c", 9, 0, "text", ""), (5008, "c", 9, 1, "text", None), (5009, "c", 9, 2, "footer", "Nobody in"), (5010, "c", 12, 0, "text", "Please enable JavaScript"),
    ]
    pages = spark.createDataFrame([("b", i, "EN") for i in range(600)] + [("c", 1, None)], "book_id string, page_index int, src_lang string")
    df = blocks_of(rows + extra)
    said = spark.createDataFrame([("block", i, 0, f"s{i}", "Please enable JavaScript") for i in range(3)], "record_kind string, record_id bigint, block_pos int, source string, content string")
    got = {r["block_id"] for r in C.cut_blocks(df.union(df.filter("block_id = 5000")), pages, said).collect()}
    assert got == {5000, 5006}
    got = {r["block_id"] for r in C.cut_blocks(df, pages, said.limit(2)).collect()}  # a message that doesn't recur is no case of problem 2
    assert got == {5000, 5006, 5010}


def test_a_paragraph_that_goes_on_in_upper_case(spark, blocks_of):
    rng = random.Random(8)
    rows = [(i, "b", i, 0, "text", prose(rng, 4)) for i in range(300)]
    pages = [(f"{prose(rng, 1)} Nobody in", "Dorela could explain why the wall panel outlasted the side note by 9 hours.") for _ in range(3)]
    pages += [(f"{prose(rng, 1)} The water sample near Kelora was compared with the paper", "Nobody in Dorela could explain why the wall panel outlasted the side note by 9 hours.") for _ in range(3)]
    for k, (end, start) in enumerate(pages):
        rows += [(5000 + k, "c", 10 * k, 0, "text", end), (6000 + k, "c", 10 * k + 1, 0, "text", start)]
    got = {r["block_id"] for r in C.cut_blocks(blocks_of(rows), spark.createDataFrame([("b", 1, "en")], "book_id string, page_index int, src_lang string")).collect()}
    assert got == {5003, 5004, 5005}


def test_contexts_in_several_passes(spark, blocks_of):
    rng = random.Random(9)
    df = blocks_of([(i, "b", i, 0, "text", prose(rng, 2) + " And so on") for i in range(40)])
    tails = spark.createDataFrame([(i, [int(x) for x in C.signed(C.np.random.default_rng(k).integers(0, 9, 3, dtype=C.np.uint64))]) for i in range(9) for k in range(4)], "block_id bigint, grams array<bigint>")
    body = df.select("content")
    whole, parts = (sorted(map(tuple, C.context_counts(body, tails, most).collect())) for most in (1000, 2))
    assert whole == parts and whole


def test_best_split_finds_the_valley():
    assert -3 <= C.best_split([(-6.0, 50), (-5.5, 40), (2.0, 900), (2.5, 100)]) <= -0.5
    assert C.best_split([]) == -3.0 and C.best_split([(1.0, 5)]) == -3.0

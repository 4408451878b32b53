import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import p6_near as N
from pagewright.llm import p7_leaks as K
from pagewright.llm import p8_mix as M
from pagewright.llm import p9_encoding as E
from pagewright.llm.vec import Words

VOCABULARY = [f"w{i}" for i in range(400)]


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 30 else set()


def test_near_duplicates_equal_brute_force(spark, blocks_of):
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        base = [rng.choice(VOCABULARY) for _ in range(rng.randrange(31, 70))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            t = list(base)
            for _ in range(rng.randrange(5)):
                t[rng.randrange(len(t))] = rng.choice(VOCABULARY)
            texts.append(" ".join(t))
    same = "The same words, again and again; " * 8  # a class of copies that is a third of all rows
    texts += [same.upper() if i % 2 else same for i in range(80)]
    texts += ["", None, "too short to count", " ".join(["tie"] * 40), " ".join(["tie"] * 41)]
    df = blocks_of([(i, "b", i, 0, "text", t) for i, t in enumerate(texts)])
    members, links = N.classes_and_links(df.union(df.limit(10)))
    got = {tuple(r) for r in N.pairs_of(members, links).collect()}
    sets = [shingles(t) for t in texts]
    expected = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    assert got == expected and len(expected) > 3000


def test_near_duplicates_with_rare_word_edits(spark, blocks_of):
    rng = random.Random(12)
    texts = []
    for i in range(250):  # frequent words only; the copy's edits bring words that stand nowhere else
        base = [rng.choice(VOCABULARY) for _ in range(rng.randrange(60, 90))]
        edited = list(base)
        for k in rng.sample(range(0, len(base), 4), 5):
            edited[k] = f"misread{i}x{k}"
        texts += [" ".join(base), " ".join(edited)]
    texts += [" ".join(rng.choice(VOCABULARY) for _ in range(80)) for _ in range(800)]
    members, links = N.classes_and_links(blocks_of([(i, "b", i, 0, "text", t) for i, t in enumerate(texts)]))
    got = {tuple(r) for r in N.pairs_of(members, links).collect()}
    sets = [shingles(t) for t in texts]
    expected = {(i, i + 1) for i in range(0, 500, 2) if len(sets[i] & sets[i + 1]) >= 0.6 * len(sets[i] | sets[i + 1])}
    assert got == expected and len(expected) > 60


def test_prefixes_of_alike_sets_meet():
    rng = random.Random(13)
    for _ in range(2000):
        shared, a, b = rng.randrange(1, 60), rng.randrange(20), rng.randrange(20)
        order = rng.sample(range(200), shared + a + b)
        x, y = sorted(order[: shared + a]), sorted(order[:shared] + order[shared + a :])
        if shared >= 0.6 * (shared + a + b):
            n = N.prefix_length(np.array([len(x), len(y)]), 0.6)
            assert set(x[: n[0]]) & set(y[: n[1]])


def test_components_equal_brute_force(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    df = spark.createDataFrame([e for e in edges if e[0] != e[1]], "a bigint, b bigint")
    group = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    assert {r["class"]: r["group"] for r in N.components(df).collect()} == group


def test_agreements_count_equal_symbols(spark):
    rng = np.random.default_rng(3)
    a, b = (rng.integers(-(2**63), 2**63 - 1, 50) for _ in range(2))
    rows = [(int(x), int(y)) for x, y in zip(a, b, strict=True)] + [(5, 5), (-1, 0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a bigint, b bigint").select(N._agreements("a", "b")).collect()]
    assert got == [sum((x >> 4 * k) & 15 == (y >> 4 * k) & 15 for k in range(16)) for x, y in rows]


def test_every_shared_run_is_found(spark):
    rng = random.Random(10)
    items = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(40))) for i in range(20)] + [(20, ""), (21, None), (22, "short passage")]
    docs = []
    for i in range(200):
        w = [rng.choice(VOCABULARY) for _ in range(80)]
        if i % 3 == 0:  # a third of all documents hold a part of the first item
            n = rng.randrange(9, 16)
            at = rng.randrange(40 - n)
            w[10:10] = items[rng.choice([0, 0, rng.randrange(20)])][1].split()[at : at + n]
        docs.append((i, ", ".join(w).upper()))
    docs += [(900, None), (901, ""), (902, items[3][1] * 300)]
    i = spark.createDataFrame(items, "item_id bigint, passage string").withColumn("text", F.lit(1))
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("print", F.lit(1))
    got = {(r["item_id"], r["doc_id"]) for r in K.leaks(i.union(i), d).collect()}
    runs = lambda t: {tuple(w[k : k + 12]) for w in [words(t)] for k in range(len(w) - 11)}
    expected = {(a, b) for a, p in items for b, t in docs if runs(p) & runs(t)}
    assert got == expected and (3, 902) in expected and len(expected) > 20


def test_pivotal_keeps_the_sum_and_the_expectations():
    p = np.array([0.2, 0.7, 0.5, 0.9, 0.1, 0.3, 0.0, 1.0])
    total = np.zeros(len(p))
    for seed in range(4000):
        out, left = M.pivotal(p, np.random.default_rng(seed))
        assert abs(out.sum() - p.sum()) < 1e-9 and all(x in (0, 1) for k, x in enumerate(np.round(out, 9)) if k != left)
        total += out
    assert np.abs(total / 4000 - p).max() < 0.04


def test_mixture(spark):
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(5, 60))), rng.choice(["Big", " big ", "BIG"])) for i in range(3000)]
    docs += [(10_000 + i, "tiny text here", "small") for i in range(5)] + [(20_000, None, "big"), (20_001, "", "big"), (20_002, "no source", None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("tokens", F.lit(1)).withColumn("rate", F.lit(1))
    t = spark.createDataFrame([(1, "BIG", 0.9, 1), (1, "small", 0.05, 8), (1, "missing", 0.05, 2)], "mix_id int, source string, target_share double, max_repeats int")
    copies, rates = M.mixed(d, t)
    rows = copies.collect()
    by = {s: sum(r["tokens"] * r["copies"] for r in rows if r["source"] == s) for s in ("big", "small")}
    assert max(r["copies"] for r in rows if r["source"] == "small") <= 8 and max(r["copies"] for r in rows if r["source"] == "big") <= 1
    assert abs(by["small"] / sum(by.values()) - 0.05 / 0.95) < 0.01 and len({r["doc_id"] for r in rows}) == len(rows)
    assert {r["source"]: r["rate"] for r in rates.collect()}["missing"] == 0.0
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mixed(d, t)[0].collect()))


FRENCH = "Les échantillons d’été près de l’étagère ont été comparés ; la référence était élevée, à côté du châssis, où l’on règle déjà le débit."
RUSSIAN = "Никто не объяснил, почему лоток для проб прослужил дольше, чем пульт управления, и журнал отказов остался пустым."
CHINESE = "没有人能解释为什么下层书架比压力表多用了很久，阅读顺序已备好，请保持干燥。"


@pytest.mark.parametrize(
    ("text", "read_as", "written_in"),
    [(FRENCH, "cp1252", "utf-8"), (FRENCH.replace("’", "'"), "mac_roman", "utf-8"), (FRENCH.replace("’", "'"), "cp850", "cp1252"), (RUSSIAN, "cp1251", "utf-8"), (RUSSIAN, "koi8_r", "cp1251"), (RUSSIAN, "latin-1", "cp1251"), (CHINESE, "latin-1", "utf-8"), (CHINESE, "latin-1", "gbk")],
)
def test_round_trips(judge, text, read_as, written_in):
    garbled = text.encode(written_in).decode(read_as)
    lang = {FRENCH[:3]: "fr", RUSSIAN[:3]: "ru", CHINESE[:3]: "zh"}[text[:3]]
    assert judge.restore([garbled], [lang])[0][0] == text
    twice = text.encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1")
    assert judge.restore([twice], [lang])[0][0] == text


@pytest.mark.parametrize("text", ["naïve œuvre", "√2 · 797", "SÃO PAULO", "L’ÂGE DES RELIURES", "½ § 310", "¿397?", "30 °C ± 7 µm", "ÉTÉ À PARIS", FRENCH, RUSSIAN, CHINESE])
def test_right_texts_stay(judge, text):
    assert judge.restore([text], ["fr"]) == [(text, "")]


@pytest.fixture(scope="module")
def judge(spark):
    def clean(t, i):
        parts = re.split(r"(?<=[ ，])", t)
        random.Random(i).shuffle(parts)
        return "".join(parts) + "\n" + t

    rows = [(i, clean(t, i), lang) for lang, t in (("fr", FRENCH), ("FR ", FRENCH), ("ru", RUSSIAN), ("zh", CHINESE), ("en", "Some plain words — “quoted” ones too.")) for i in range(60)]
    return E.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))


def test_documents(spark):
    good = [(i, f"{FRENCH}\n{i}", "fr") for i in range(60)]
    bad = [(100, "Bonjour\n" + FRENCH.encode().decode("latin-1"), "fr"), (101, "perdu � ici", None), (102, None, "fr"), (103, "", "und"), (104, "plain ascii", None)]
    d = spark.createDataFrame(good + bad + bad[:1], "doc_id bigint, text string, lang string").withColumn("chains", F.lit(1))
    got = {r["doc_id"]: (r["text"], r["lost"]) for r in E.restored(d).collect()}
    assert set(got) == {100, 101} and got[100] == ("Bonjour\n" + FRENCH, False) and got[101] == ("perdu � ici", True)


@pytest.mark.parametrize(("read_as", "written_in"), [("latin-1", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("latin-1", "utf-8")])
def test_a_source_that_garbles_a_third_of_a_language(spark, read_as, written_in):
    rng = random.Random(14)
    nouns = RUSSIAN.replace(",", "").replace(".", "").split()
    right = [" ".join(rng.choice(nouns) for _ in range(14)).capitalize() + "." for _ in range(240)]
    rows = [(i, t.encode(written_in).decode(read_as) if i % 3 == 0 else t, "ru") for i, t in enumerate(right)]
    rows += [(1000 + i, FRENCH, "fr") for i in range(40)]
    got = {r["doc_id"]: r["text"] for r in E.restored(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got == {i: t for i, t in enumerate(right) if i % 3 == 0}


def test_a_paragraph_garbled_in_part(judge):
    text = FRENCH + " \u00bd " + FRENCH.encode().decode("latin-1")
    assert judge.candidates([text])[0] == [] or all(t.count("\ufffd") <= 2 for t, _, _ in judge.candidates([text])[0])


@pytest.mark.parametrize("read_as", ["cp1251", "koi8_r", "cp866", "mac_roman", "latin-1", "cp437"])
@pytest.mark.parametrize("written_in", ["cp1251", "koi8_r", "cp866"])
def test_every_word_of_another_alphabet(judge, read_as, written_in):
    if read_as == written_in or (read_as, written_in) in [("cp437", "koi8_r"), ("cp437", "cp866"), ("mac_roman", "koi8_r"), ("mac_roman", "cp866")]:
        return  # not among the pairs
    words = RUSSIAN.replace(",", "").replace(".", "").split()
    for k in range(0, len(words) - 4, 3):
        text = " ".join(words[k : k + 5])
        try:
            garbled = text.encode(written_in).decode(read_as)
        except UnicodeError:
            continue
        assert judge.restore([garbled], ["ru"])[0][0] == text


@pytest.mark.parametrize(("first", "second"), [(("latin-1", "cp1251"), ("latin-1", "utf-8")), (("latin-1", "cp1251"), ("cp1251", "utf-8")), (("koi8_r", "cp1251"), ("latin-1", "utf-8")), (("latin-1", "cp1251"), ("mac_roman", "latin-1"))])
def test_chains_of_unlike_steps(judge, first, second):
    text = RUSSIAN
    for read_as, written_in in (first, second):
        text = text.encode(written_in).decode(read_as)
    assert judge.restore([text], ["ru"])[0][0] == RUSSIAN


def test_a_very_long_paragraph(judge):
    text = " ".join([FRENCH] * 4000)
    garbled = text.encode().decode("latin-1")
    assert judge.restore([garbled, text], ["fr", "fr"]) == [(text, "utf-8 read as win"), (text, "")]
    code = E.codes([garbled[:5000]])[0]
    maps = E.np.arange(len(E.chains().unicode))
    assert E.chains().read_as_unicode(code, maps) == E.chains().read_as_unicode(code, maps, 7)


def test_lost_characters_stay_lost(judge):
    assert E.step("d\u00e9j\u00e0 \ufffd ici", "win", "cp850") == "d\u00daj\u00d3 \ufffd ici" and E.step("a \ufffd b", "gbk", "win") is None


def test_strangers_end_where_they_meet(spark):
    rng = np.random.default_rng(5)
    rows, size = [], rng.integers(40, 60, 3000)  # a shingle that 3,000 blocks share, and two that no others do
    prints = rng.integers(-(2**62), 2**62, (3000, 2))
    prints[1::100] = prints[::100] ^ 15  # one symbol of 32 differs
    size[1::100] = size[::100]
    for k in range(3000):
        rows += [(int(N.packed(np.array([key], dtype=np.uint64), size[k : k + 1], np.array([short]))[0]), *map(int, prints[k])) for key, short in ((1 << 40, k % 3 == 0), (k << 20, True))]
    rows += rows[:500]  # copies of another batch
    df = spark.createDataFrame(sorted(rows), "row bigint, f bigint, g bigint").coalesce(1)
    symbols = lambda v: (v[:, :, None].view(np.uint64) >> (np.arange(16, dtype=np.uint64) * np.uint64(4))) & np.uint64(15)
    s = symbols(prints).reshape(3000, 32)
    expected = set()
    step = (np.log(size) / np.log(N.SIZE_STEP)).astype(int)
    for a in range(3000):
        close = np.flatnonzero((s == s[a]).sum(axis=1) >= N.least_agreements(0.6))
        expected |= {(a, int(b)) for b in close if a < b and any(x % 3 == 0 and step[x] <= step[y] for x, y in ((a, b), (b, a)))}
    name = {tuple(map(int, v)): k for k, v in enumerate(prints)}
    for held in (100, 500_000):
        found = df.mapInArrow(N._meetings(0.6, held, 1000), "f_a bigint, g_a bigint, f_b bigint, g_b bigint").collect()
        pairs = {tuple(sorted((name[r[0], r[1]], name[r[2], r[3]]))) for r in found}
        assert pairs == expected and len(pairs) < 100  # of 4.5 million that meet


def test_the_order_counts_all_blocks(spark, blocks_of):
    rng = random.Random(14)
    texts = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(50))) for _ in range(90)] + [None, ""]
    df = blocks_of([(i, "b", i, 0, "text", t) for i, t in enumerate(texts)])
    g = np.concatenate([Words([t]).grams(3)[0] for t in texts])
    counts = N.shingle_counts(df.union(df).repartition(3))
    assert (counts == 2 * np.bincount(N._bucket(g), minlength=N.BUCKETS)).all()

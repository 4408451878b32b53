"""Problem 3: noise of scanned pages in body blocks and in service pages' markdown, and its repair.

Method: skip-gram vectors with negative sampling are learned for the corpus's frequent words from the counts of all word
pairs within two words. A rare word is linked to the frequent word from which glyphs that scanners confuse differ (both have
the same skeleton once such glyphs are merged, so the link is a look-up, not a comparison of words), and is corrected where
its context fits that word, as the vectors tell, or a glyph in it can't be meant. A word with such a glyph may stand for any
word seen SEVERAL times, frequent or not: those links are a join by skeleton over the counts of all words. Then running heads and page numbers go,
words broken at line ends are joined, and lines are reflowed into paragraphs.

A running head is a line with the letters of one of the book's header blocks; a page number is a line in the book's form of
number blocks with this page's number (the most frequent distance of number and page index). Null and empty texts yield
nothing; records that come twice yield each row once; books without header or number blocks have no such noise.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, bitmap, cut_lineage, frequent_words, in_bitmap, is_body, letters, map_arrow, slices, strings, table
from .vec import Words, letter_table, signed

#: A word has a vector from this share of all words on: at most 200,000 words in any corpus.
FREQUENT_SHARE = 5e-6
#: A word without a vector is a misreading only where a glyph can't be meant, of a word that was seen so often, and so many
#: times as often as itself.
SEVERAL, OFTENER = 5, 3
#: Pairs of frequent words from this share of all pairs on train the vectors: at most 500,000 pairs.
PAIR_SHARE = 2e-6
#: Without such a glyph, context decides on a word too rare for a vector only where the word it may stand for is this many times
#: as frequent as the rarest with one: in any language some rare word looks like another that isn't much less rare.
CLEARLY = 12
WINDOW = 2
DIMENSIONS = 24
#: A word is a misreading only of one that is this many times as frequent.
TIMES = 30

# Glyphs that scanners confuse, each group under its first letter; pairs of glyphs read for one.
GROUPS = ["o0", "l1|", "iı", "s5$", "b6h", "ec", "a@", "tf", "g9", "z2", "ин", "шщ", "о0", "з3"]
MERGED = [("r", "n", "m"), ("e", "l", "d"), ("v", "v", "w"), ("i", "i", "u"), ("l", "i", "b")]  # in merged glyphs: c stands under e, h under b
#: Glyphs that no word of these languages has.
IMPOSSIBLE = "0123456789@|$ı"

BROKEN = re.compile(r"([^\W\d_]{1,40})([-‐¬­])[ \t]*\n[ \t]*([^\W\d_]{1,40})")
ALWAYS = "¬­"
HYPHENS = "-‐¬­"


def _glyph_table() -> np.ndarray:
    t = np.arange(0x110000, dtype=np.uint32)
    for g in GROUPS:
        for c in g[1:]:
            t[ord(c)] = ord("o") if c == "0" else ord(g[0])
    t[ord("о")], t[ord("б")] = ord("o"), ord("b")  # so that a 0 or 6 may stand for either alphabet's letter
    return t


_GLYPHS: list = []


def skeletons(flat: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not _GLYPHS:
        _GLYPHS.append(_glyph_table())
    out = np.where(inside, _GLYPHS[0][flat], flat)
    keep = np.ones(len(out), dtype=bool)
    for a, b, c in MERGED:
        at = np.flatnonzero((out[:-1] == ord(a)) & (out[1:] == ord(b)))
        if a == b and len(at):
            at = at[np.concatenate([[True], np.diff(at) > 1])]
        out[at] = ord(c)
        keep[at + 1] = False
    return out, keep


def is_piece(flat: np.ndarray, start: int, end: int) -> bool:
    """Is the word a part of one: broken at a line end, or cut at the text's?"""
    after = end
    if flat[after] == 0:
        return True
    if chr(flat[after]) in HYPHENS:
        after += 1
        while flat[after] in (32, 9):
            after += 1
        if flat[after] == 10:
            return True
    before = start - 1
    while before >= 0 and flat[before] in (32, 9):
        before -= 1
    if before < 0 or flat[before] != 10:
        return False
    before -= 1
    while before >= 0 and flat[before] in (32, 9):
        before -= 1
    return before >= 0 and chr(flat[before]) in HYPHENS


def _place(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted ones, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def pair_counts(texts: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(a, b, n): how often frequent word b follows a within WINDOW words; rows with b = -1 give the spelling of a."""
    v = len(vocabulary)
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("word", pa.string())])

    def run(batches):
        held, counts, spelled = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {}
        for whole in batches:
            for b in slices(whole, "text"):
                w = Words(strings(b.column("text")), also="@")
                at = _place(vocabulary, w.hash)
                for d in range(1, WINDOW + 1):
                    both = (at[:-d] >= 0) & (at[d:] >= 0) & (w.row[:-d] == w.row[d:])
                    k, n = np.unique(at[:-d][both].astype(np.int64) * v + at[d:][both], return_counts=True)
                    held.append(k)
                    counts.append(n)
                known, first = np.unique(at, return_index=True)
                for i, f in zip(known.tolist(), first.tolist(), strict=True):
                    if i >= 0 and i not in spelled:
                        spelled[i] = w.flat[w.start[f] : w.end[f]].astype("<u4").tobytes().decode("utf-32-le", "replace")
            if len(held) > 40:
                k, inverse = np.unique(np.concatenate(held), return_inverse=True)
                total = np.zeros(len(k), np.int64)
                np.add.at(total, inverse, np.concatenate(counts))
                held, counts = [k], [total]
        k, inverse = np.unique(np.concatenate(held), return_inverse=True)
        total = np.zeros(len(k), np.int64)
        np.add.at(total, inverse, np.concatenate(counts))
        a = np.concatenate([k // max(v, 1), list(spelled)]).astype(np.int32)
        b = np.concatenate([k % max(v, 1), np.full(len(spelled), -1)]).astype(np.int32)
        n = np.concatenate([total, np.zeros(len(spelled), np.int64)]).astype(np.int64)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n), pa.array([None] * len(k) + list(spelled.values()), pa.string())], schema=schema)

    return texts.select("text").mapInArrow(run, "a int, b int, n bigint, word string").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("word").alias("word"))


def skip_gram(a: np.ndarray, b: np.ndarray, n: np.ndarray, size: int, dims: int = DIMENSIONS, steps: int = 220, draw: int = 8192, negative: int = 3, rate: float = 0.6) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of words and of contexts, by stochastic ascent on pairs drawn by their counts and negative samples."""
    rng = np.random.default_rng(7)
    u = (rng.random((size, dims), dtype=np.float32) - 0.5) / dims
    v = np.zeros((size, dims), dtype=np.float32)
    if not len(n):
        return u, v
    p = np.cumsum(n.astype(float) ** 0.75)
    noise = np.cumsum(np.bincount(np.concatenate([a, b]), weights=np.concatenate([n, n]), minlength=size) ** 0.75)

    def add(target: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        some = np.add.reduceat(gradient[order], first, axis=0)
        many = np.diff(np.append(first, len(rows)))[:, None]
        target[rows[first]] += some * (np.minimum(np.sqrt(many), 4) / many)  # frequent words take a mean step, not their sum

    for step in range(steps):
        lr = np.float32(rate * (1 - step / steps) + 0.02)
        k = np.searchsorted(p, rng.random(draw) * p[-1])
        x, y = a[k], b[k]
        flip = rng.random(draw) < 0.5
        x, y = np.where(flip, y, x), np.where(flip, x, y)
        for good in (1, *[0] * negative):
            c = y if good else np.searchsorted(noise, rng.random(draw) * noise[-1])
            ux, vc = u[x], v[c]
            g = ((good - 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", ux, vc), -20, 20)))) * lr).astype(np.float32)[:, None]
            add(u, x, g * vc)
            add(v, c, g * ux)
    return u, v


class Reader:
    """What the workers need to tell misread words: the frequent words, their counts, spelling and skeletons, the vectors."""

    def __init__(self, texts: DataFrame):
        self.words, self.counts = frequent_words(texts, "text", FREQUENT_SHARE, also="@")
        pairs = pair_counts(texts, self.words)
        total = pairs.agg(F.sum("n") * PAIR_SHARE).scalar()
        rows = pairs.filter((F.col("b") == -1) | (F.col("n") >= total)).toArrow()
        a, b, n = (rows.column(c).to_numpy() for c in ("a", "b", "n"))
        self.spelling = [""] * len(self.words)
        for i, w in zip(a[b == -1].tolist(), rows.filter(pa.array(b == -1)).column("word").to_pylist(), strict=True):
            self.spelling[i] = w
        real = b >= 0
        a, b, n = a[real].astype(np.int64), b[real].astype(np.int64), n[real]
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        self.u, self.v = skip_gram(a, b, n, max(len(self.words), 1))
        fits = np.einsum("ij,ij->i", self.u[a], self.v[b]) if len(a) else np.zeros(1)
        weight = np.cumsum(n) if len(a) else np.ones(1)
        ranked = np.argsort(fits)
        #: nineteen of twenty word pairs fit at least as well
        self.fit = float(fits[ranked][np.searchsorted(np.cumsum(n[ranked]), 0.05 * weight[-1])]) if len(a) else 0.0
        skeleton = np.zeros(0, np.uint64)
        if self.spelling:
            w = Words([x or "?" for x in self.spelling], also="@", map_codes=skeletons)
            skeleton = w.hash[w.first[:-1]] if len(w.first) - 1 == len(self.spelling) and np.all(np.diff(w.first) == 1) else np.array([Words([x or "?"], also="@", map_codes=skeletons).hash[0] for x in self.spelling], np.uint64)
        by = np.lexsort((-self.counts, skeleton)) if len(skeleton) else np.zeros(0, np.int64)
        lead = by[np.concatenate([[True], skeleton[by][1:] != skeleton[by][:-1]])] if len(by) else by
        self.skeleton, self.lead = skeleton[lead], lead  # the most frequent word of each skeleton
        at = _place(self.skeleton, skeleton) if len(skeleton) else np.zeros(0, np.int64)
        mate = self.lead[at] if len(at) else at
        own = np.arange(len(self.words))
        self.mate = np.where((mate != own) & (self.counts[mate] >= TIMES * self.counts), mate, -1) if len(own) else own

    def misread(self, texts: list[str | None]) -> tuple[Words, np.ndarray, np.ndarray]:
        """(words, index of each misread word, index of the frequent word it stands for)."""
        w = Words(texts, also="@")
        if not len(self.words):
            none = np.zeros(0, np.int64)
            return w, none, none
        s = Words(texts, also="@", map_codes=skeletons)
        at = _place(self.words, w.hash)
        if len(s.hash) != len(w.hash):
            raise AssertionError("skeletons must keep every word")
        goal = np.full(len(w.hash), -1)
        known = at >= 0
        goal[known] = self.mate[at[known]]
        rare = np.flatnonzero(~known & (w.end - w.start >= 3))
        k = _place(self.skeleton, s.hash[rare])
        goal[rare] = np.where(k >= 0, self.lead[k] if len(self.lead) else -1, -1)
        goal[(w.end - w.start) < 3] = -1
        found = np.flatnonzero(goal >= 0)
        found = found[[not is_piece(w.flat, w.start[i], w.end[i]) for i in found.tolist()]] if len(found) else found
        if not len(found):
            return w, found, found
        seen = np.concatenate([[0], np.cumsum(np.isin(w.flat, np.array([ord(c) for c in IMPOSSIBLE], np.uint32)))])
        odd = seen[w.end[found]] > seen[w.start[found]]
        best = np.full(len(found), -np.inf)
        for d in (-2, -1, 1, 2):
            j = found + d
            inside = (j >= 0) & (j < len(w.hash))
            j = np.clip(j, 0, len(w.hash) - 1)
            ok = inside & (w.row[j] == w.row[found]) & (at[j] >= 0)
            best[ok] = np.maximum(best[ok], np.einsum("ij,ij->i", self.u[goal[found[ok]]], self.v[at[j[ok]]]))
        clear = known[found] | (self.counts[goal[found]] >= CLEARLY * self.counts.min())
        keep = odd | (clear & (best >= self.fit))
        return w, found[keep], goal[found[keep]]

    def unlinked(self, texts: list[str | None]) -> tuple[Words, np.ndarray, np.ndarray]:
        """(words, index of each with a glyph that can't be meant, two letters and no frequent word to stand for, its skeleton)."""
        w, s = Words(texts, also="@"), Words(texts, also="@", map_codes=skeletons)
        odd, letters_ = np.isin(w.flat, np.array([ord(c) for c in IMPOSSIBLE], np.uint32)), letter_table()[w.flat]
        count = lambda mask: (total := np.concatenate([[0], np.cumsum(mask)]))[w.end] - total[w.start]
        at = np.flatnonzero((count(odd) > 0) & (count(letters_) >= 2) & (w.end - w.start >= 3) & (_place(self.words, w.hash) < 0))
        at = at[_place(self.skeleton, s.hash[at]) < 0]
        at = at[[not is_piece(w.flat, w.start[i], w.end[i]) for i in at.tolist()]] if len(at) else at
        return w, at, s.hash[at]

    def broken(self, text: str) -> list[re.Match]:
        """The words broken at a line end by a mark that isn't theirs."""
        out = []
        for m in BROKEN.finditer(text):
            a, mark, b = m.groups()
            if mark not in ALWAYS:
                if not b[0].islower():
                    continue
                joined, first, second = (_place(self.words, Words([x]).hash)[0] >= 0 for x in (a + b, a, b))
                if first and second and not joined:
                    continue
            out.append(m)
        return out


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "blocks").filter(is_body() & F.col("content").isNotNull())
    pages = table(spark, sf_dir, "service_pages").filter("markdown is not null")
    return blocks.select(F.lit("block").alias("record_kind"), F.col("block_id").alias("record_id"), "book_id", "page_index", F.col("content").alias("text")).unionAll(
        pages.select(F.lit("service_page"), "service_page_id", "book_id", "page_index", "markdown")
    )


def furniture(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """(record_kind, record_id, line_no, noise) of running heads and page numbers."""
    lines = records.select("record_kind", "record_id", "book_id", "page_index", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    of = ["record_kind", "record_id", "line_no"]
    line_id = lambda c: F.xxhash64("book_id", letters(F.col(c)))
    heads = blocks.filter("type = 'header' and content is not null").select("book_id", F.explode(F.split("content", "\n")).alias("line"))
    heads = heads.unionByName(blocks.filter("type = 'header' and content is not null").select("book_id", F.col("content").alias("line")))
    heads = heads.filter(letters(F.col("line")) != "").select(line_id("line").alias("id")).distinct()
    head_rows = lines.filter(letters(F.col("line")) != "").select(*of, line_id("line").alias("id")).join(heads, "id", "left_semi").select(*of, F.lit("running_header").alias("noise"))

    form = lambda c: F.regexp_replace(F.trim(F.col(c)), r"\d+", "0")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '[0-9]{{1,9}}', 0) as int)")
    said = blocks.filter("type = 'number' and content is not null").select("block_id", "book_id", "page_index", form("content").alias("form"), (number("content") - F.col("page_index")).alias("ahead")).distinct()
    votes = said.groupBy("book_id", "form", "ahead").agg(F.countDistinct("page_index").alias("pages"))
    best = votes.groupBy("book_id").agg(F.max(F.struct("pages", "form", "ahead")).alias("b")).select("book_id", "b.form", "b.ahead").filter("ahead is not null")
    best = cut_lineage(best)
    longest = best.agg(F.max(F.length("form"))).first()[0] or 0
    numbers = lines.filter(F.col("line").rlike(r"\d")).withColumn("form", form("line")).filter(F.length("form") <= longest)
    numbers = numbers.withColumn("ahead", number("line") - F.col("page_index")).select(*of, "book_id", "form", "ahead")
    number_rows = numbers.join(best, ["book_id", "form", "ahead"], "left_semi").select(*of, F.lit("page_number").alias("noise"))
    return head_rows.unionByName(number_rows)


def _noise(reader_of):
    def run(whole: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        reader, rows, kinds = reader_of(), [], []
        done = 0
        for b in slices(whole, "text"):
            texts = strings(b.column("text"))
            w, found, _ = reader.misread(texts)
            hit = np.unique(w.row[found]).tolist()
            broken = [i for i, t in enumerate(texts) if t and "\n" in t and reader.broken(t)]
            rows += [done + i for i in hit + broken]
            kinds += ["misread"] * len(hit) + ["hyphenation"] * len(broken)
            done += b.num_rows
        took = whole.take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([took.column("record_kind"), took.column("record_id"), pa.array(kinds, pa.string())], schema=schema)

    return run


def _spelled(w: Words, i: int) -> str:
    return w.flat[w.start[i] : w.end[i]].astype("<u4").tobytes().decode("utf-32-le", "replace")


def odd_links(records: DataFrame, reader) -> DataFrame:
    """(record_kind, record_id, word, stands_for) of the words with a glyph that can't be meant that no frequent word explains. The
    words that they may stand for are counted over all texts; which are worth counting a bitmap of bounded size tells."""
    schema = pa.schema([("skeleton", pa.int64()), ("word", pa.string()), ("n", pa.int64())])

    def odd(whole: pa.RecordBatch, out: pa.Schema) -> pa.RecordBatch | None:
        rows, words, keys, done = [], [], [], 0
        for b in slices(whole, "text"):
            w, at, skeleton = reader().unlinked(strings(b.column("text")))
            rows += (w.row[at] + done).tolist()
            words += [_spelled(w, i) for i in at.tolist()]
            keys.append(signed(skeleton))
            done += b.num_rows
        took = whole.take(pa.array(rows, pa.int64()))
        return batch(out, took.column("record_kind"), took.column("record_id"), words, np.concatenate(keys))

    found = cut_lineage(map_arrow(records.select("record_kind", "record_id", "text"), odd, "record_kind string, record_id bigint, word string, skeleton bigint").distinct())
    bits = records.sparkSession.sparkContext.broadcast(bitmap(found, "skeleton"))

    def meant(batches):
        for whole in batches:
            n: dict[tuple[int, str], int] = {}
            for b in slices(whole, "text"):
                texts = strings(b.column("text"))
                s = Words(texts, also="@", map_codes=skeletons)
                some = np.flatnonzero(in_bitmap(bits.value, s.hash))
                if len(some):
                    w = Words(texts, also="@")
                    for i in some.tolist():
                        word = _spelled(w, i)
                        if not any(c in IMPOSSIBLE for c in word):
                            k = int(s.hash[i].view(np.int64)), word
                            n[k] = n.get(k, 0) + 1
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.int64()), pa.array([k[1] for k in n]), pa.array(list(n.values()), pa.int64())], schema=schema)

    counts = records.select("text").mapInArrow(meant, "skeleton bigint, word string, n bigint").groupBy("skeleton", "word").agg(F.sum("n").alias("n"))
    best = counts.groupBy("skeleton").agg(F.max(F.struct("n", "word")).alias("best")).filter(F.col("best.n") >= SEVERAL)
    own = found.groupBy("skeleton", "word").agg(F.count("*").alias("times"))
    fine = own.join(best, "skeleton").filter(F.col("best.n") >= OFTENER * F.col("times")).select("skeleton", "word", F.col("best.word").alias("stands_for"))
    return found.join(fine, ["skeleton", "word"]).select("record_kind", "record_id", "word", "stands_for")


def _shared(spark: SparkSession, reader: Reader):
    sent = spark.sparkContext.broadcast(reader)  # bounded: FREQUENT_SHARE and DIMENSIONS
    return lambda: sent.value


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    reader = _shared(spark, Reader(r))
    words = map_arrow(r.select("record_kind", "record_id", "text"), _noise(reader), "record_kind string, record_id bigint, noise string")
    odd = odd_links(r, reader).select("record_kind", "record_id", F.lit("misread").alias("noise"))
    return words.unionByName(odd).unionByName(furniture(r, table(spark, sf_dir, "blocks")).select("record_kind", "record_id", "noise")).distinct()


def _as_written(old: str, new: str) -> str:
    return new.upper() if len(old) > 1 and old.isupper() else new.capitalize() if old[:1].isupper() else new


def repair(text: str, gone: set[int], reader: Reader, links: dict[str, str] | None = None) -> str:
    """The text without the lines `gone`, with misread words corrected, broken words joined and lines reflowed: a line that
    ends without a stop runs on, unless the next line starts a list item, a heading or a table."""
    w, found, goal = reader.misread([text])
    if len(text.lower()) == len(text):
        for i, g in sorted(zip(found.tolist(), goal.tolist(), strict=True), reverse=True):
            old, new = text[w.start[i] : w.end[i]], reader.spelling[g]
            text = text[: w.start[i]] + _as_written(old, new) + text[w.end[i] :]
    if links:
        text = re.sub(r"[\w@|$]+", lambda m: _as_written(m.group(), links[m.group().lower()]) if m.group().lower() in links else m.group(), text)
    lines = [x for n, x in enumerate(text.split("\n")) if n not in gone]
    text = "\n".join(lines)
    for m in reversed(reader.broken(text)):
        text = text[: m.end(1)] + m.group(3) + text[m.end() :]
    paragraphs = []
    for p in re.split(r"\n\s*\n", text):
        out = ""
        for x in (y.strip() for y in p.split("\n")):
            if not x:
                continue
            starts = re.match(r"(?:#{1,6} |[-*] |\d+[.)] |\||<|\$\$)", x)
            join = " " if not re.search(r"[぀-鿿，。；、：]$", out) else ""
            out = x if not out else out + ("\n" if starts else join) + x
        if out:
            paragraphs.append(out)
    return "\n\n".join(paragraphs)


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with noise and their repaired texts."""
    r = cut_lineage(records(spark, sf_dir).dropDuplicates(["record_kind", "record_id"]))
    reader = _shared(spark, Reader(r))
    gone = furniture(r, table(spark, sf_dir, "blocks")).groupBy("record_kind", "record_id").agg(F.collect_set("line_no").alias("gone"))

    links = odd_links(r, reader).groupBy("record_kind", "record_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "stands_for"))).alias("links"))

    def run(b: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        texts, gone, known = strings(b.column("text")), b.column("gone").to_pylist(), [dict(x or ()) for x in b.column("links").to_pylist()]
        w, found, _ = reader().misread(texts)
        hit = set(np.unique(w.row[found]).tolist())
        rows = [i for i, t in enumerate(texts) if i in hit or gone[i] or known[i] or ("\n" in t and reader().broken(t))]
        took = b.take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([took.column("record_kind"), took.column("record_id"), pa.array([repair(texts[i], set(gone[i] or ()), reader(), known[i]) for i in rows], pa.string())], schema=schema)

    every = r.join(gone, ["record_kind", "record_id"], "left").join(links, ["record_kind", "record_id"], "left")
    return map_arrow(every.select("record_kind", "record_id", "text", "gone", "links"), run, "record_kind string, record_id bigint, text string")


QUERIES = {"p3_found": p3_found, "p3_repaired": p3_repaired}
SQL: dict[str, str] = {}

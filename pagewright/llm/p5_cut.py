"""Problem 5: text cut off by field limits or a broken transfer.

Method: a backward character n-gram model. Texts are masked (numbers to 0, capitalised words to N, white space to one space),
and the final context of a text, its last 3 to 24 characters read backwards from the end, is looked up from the longest
order down. For the longest context that recurs as an end, the log-odds of "a text ends here" against "a text goes on here"
are taken from counts over all texts, and compared with a threshold fitted for each language and type (the best split of the
log-odds' histogram).

Only texts that don't end with a full stop are asked; taken out are paragraphs that go on in the first body block of the next
page, those that lead into a formula below, lines that recur in the book as a notice or running head, and leftovers of templates (problem 2). Null, empty and blank texts are no cases.
Redelivered blocks give one row; they weigh in the counts as they come.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, cut_lineage, is_body, letters, map_arrow, slices, strings, table
from .vec import _BASE, _BASE_INV, _powers, codes, letter_table, mix, signed

ORDERS = (3, 5, 8, 12, 16, 24)
MIN_ENDS = 3
#: How many masked characters of a next page's start are looked at, the first characters that hold them, and what ends a sentence.
HEADS = (4, 8, 12, 20)
HEAD = 400
_STOPS = np.array([ord(c) for c in ".。!?！？…"], np.uint32)
_BLANK = np.array([ord(c) for c in " \"'’”»)]）」』«“„(["], np.uint32)
#: A last line that ends texts on this many pages of a book, or is its header, footer or page number, is complete.
MIN_PAGES = 3
#: So many final contexts (8 bytes each) are sent out at once; if more recur, the texts are counted in several passes.
CONTEXTS = 2_000_000

# What a text that was cut may carry after the cut, and what ends a sentence.
MARK = re.compile(r"\s*(?:\[cut\]|\[\s*(?:\.\.\.|…)\s*\]|\(?(?:truncated|gekürzt|tronqué)\)?|…|\.\.\.|<|�+|✂)\s*$", re.I)
STOP = re.compile(r"[.。!?！？…](?:[\s\"'’”»)\]）」』]*)$")


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import unicodedata

    upper = np.zeros(0x110000, dtype=bool)
    digit = np.zeros(0x110000, dtype=bool)
    space = np.zeros(0x110000, dtype=bool)
    for c in range(0x30000):
        k = unicodedata.category(chr(c))
        upper[c], digit[c], space[c] = k in ("Lu", "Lt"), k == "Nd", k == "Zs" or c in (9, 10, 11, 12, 13)
    return upper, digit, space


def masked(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, ends): the masked texts with a 0 before the first and after each; ends: the place of the 0 after each."""
    flat, _, _ = codes(texts)
    flat = np.concatenate([np.zeros(1, np.uint32), flat])
    upper, digit, space = _tables()
    letter, up, dig, spc = letter_table()[flat], upper[flat], digit[flat], space[flat]
    before = lambda m: np.concatenate([[False], m[:-1]])
    start = letter & ~before(letter)
    head = np.maximum.accumulate(np.where(start, np.arange(len(flat)), 0))
    proper = letter & up[head]
    keep = ~((proper & ~start) | (dig & before(dig)) | (spc & before(spc)))
    out = flat.copy()
    out[proper & start] = 78
    out[dig] = 48
    out[spc] = 32
    out = out[keep]
    return out, np.flatnonzero(out == 0)[1:]


def context_hashes(flat: np.ndarray, at: np.ndarray, order: int, sums: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hash of the `order` characters that end at each place `at` (fewer, with the mark of the start, in a shorter text)."""
    return _range_hashes(flat, np.maximum(at - order + 1, begin), at, order, sums)


def _range_hashes(flat: np.ndarray, first: np.ndarray, at: np.ndarray, order: int, sums: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        raw = (sums[at + 1] - sums[first]) * _powers(_BASE_INV, len(flat) + 1)[first]
        return mix(raw + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order))


def _sums(flat: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(flat) + 1)[:-1], dtype=np.uint64)])


def _tails(b: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """Rows that don't end with a full stop and hold no placeholder, with the hashes of their final contexts, whether a cut's
    mark follows, and the messages in them."""
    from .p2_residue import hashed, messages

    rows, texts, marks, said = [], [], [], []
    for i, t in enumerate(strings(b.column("content"))):
        t = (t or "").rstrip()
        m = MARK.search(t, max(0, len(t) - 60))  # marks are shorter
        kept = t[: m.start()].rstrip() if m else t
        if kept and not STOP.search(kept, max(0, len(kept) - 60)):
            found = messages(t)
            if not any(placeholder for _, placeholder in found):
                rows.append(i)
                texts.append(kept)
                marks.append(bool(m))
                said.append([hashed(x) for x, _ in found])
    if not rows:
        return None
    flat, ends = masked(texts)
    sums, last = _sums(flat), ends - 1
    begin = np.concatenate([[0], ends[:-1]])
    grams = np.stack([context_hashes(flat, last, n, sums, begin) for n in ORDERS], axis=1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, grams.size + 1, len(ORDERS), dtype=np.int32)), pa.array(signed(np.ascontiguousarray(grams.reshape(-1)))))
    took = b.take(pa.array(rows))
    cols = [took.column(n) for n in ("block_id", "book_id", "page_index", "block_pos", "type", "line")]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*cols, pa.array(marks), pa.array(said, pa.list_(pa.int64())), lists], schema, strict=True)], schema=schema)


def _tracked_counts(df: DataFrame, tracked: np.ndarray, places) -> DataFrame:
    """(key, n, m): how often each tracked hash is among those that `places(flat, ends, sums)` yields as (hashes, count in m
    instead of n?) of all texts' masked characters; summed by partition before the shuffle."""
    bits = max(16, int(np.ceil(np.log2(max(len(tracked), 1)))) + 4)
    shift = np.uint64(64 - bits)
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("m", pa.int64())])

    def run(batches):
        present = np.zeros(1 << bits, dtype=bool)
        present[(tracked >> shift).astype(np.int64)] = True
        total = np.zeros((2, len(tracked) + 1), dtype=np.int64)
        for whole in batches:
            for b in slices(whole, "content"):
                flat, ends = masked([(t or "").rstrip() for t in strings(b.column("content"))])
                for h, other in places(flat, ends, _sums(flat)):
                    some = np.flatnonzero(present[(h >> shift).astype(np.int64)])
                    h = h[some]
                    place = np.minimum(np.searchsorted(tracked, h), len(tracked) - 1)
                    hit = tracked[place] == h
                    into = other[some][hit].astype(np.int64) if other is not None else 0
                    total += np.bincount(into * total.shape[1] + place[hit], minlength=total.size).reshape(total.shape)
        some = np.flatnonzero(total[:, :-1].sum(axis=0))
        if len(some):
            yield batch(schema, signed(tracked[some]), total[0, some], total[1, some])

    return df.select("content").mapInArrow(run, "key bigint, n bigint, m bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _counted(df: DataFrame, keys: DataFrame, places, most: int) -> DataFrame:
    """`_tracked_counts` of the keys, at most about `most` of which are sent out at once; more take several passes."""
    passes = max(1, -(-keys.count() // most))
    out = None
    for k in range(passes):
        part = keys.filter(F.pmod("key", F.lit(passes)) == k) if passes > 1 else keys
        tracked = np.sort(part.select("key").toArrow().column("key").to_numpy().astype(np.int64).view(np.uint64))
        if len(tracked):
            counts = _tracked_counts(df, tracked, places)
            counts = cut_lineage(counts) if passes > 1 else counts
            out = counts if out is None else out.unionByName(counts)
    return out if out is not None else keys.sparkSession.createDataFrame([], "key bigint, n bigint, m bigint")


def _inner(flat: np.ndarray, ends: np.ndarray, sums: np.ndarray):
    """The contexts before every place inside a text."""
    begin = np.concatenate([[0], ends])
    inside = flat != 0
    inside[ends - 1] = False
    at = np.flatnonzero(inside)
    first = begin[np.searchsorted(ends, at)]
    for n in ORDERS:
        yield context_hashes(flat, at, n, sums, first), None


def _words(flat: np.ndarray, ends: np.ndarray, sums: np.ndarray):
    """What follows every place where a word starts, and whether that is inside a sentence (else a text or sentence starts)."""
    letter = letter_table()[flat] | (flat == 48)
    han = (flat >= 0x3040) & (flat <= 0x9FFF)
    at = np.flatnonzero(letter[1:] & (~letter[:-1] | han[1:])) + 1
    solid = np.where(np.isin(flat, _BLANK), 0, np.arange(len(flat)))
    before = flat[np.maximum.accumulate(solid)[at - 1]]
    last = ends[np.searchsorted(ends, at)] - 1
    inside = ~((flat[at - 1] == 0) | (before == 0) | np.isin(before, _STOPS))
    for n in HEADS:
        yield _range_hashes(flat, at, np.minimum(at + n - 1, last), n, sums), inside


def _heads(b: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The hashes of each text's first masked characters from its first word on."""
    flat, ends = masked([t or "" for t in strings(b.column("head"))])
    sums, start = _sums(flat), np.concatenate([[0], ends[:-1]]) + 1
    word = np.flatnonzero(letter_table()[flat] | (flat == 48))
    place = np.searchsorted(word, start)
    first = np.minimum(np.append(word, len(flat) - 1)[place], ends)
    grams = np.stack([_range_hashes(flat, first, np.minimum(first + n - 1, np.maximum(ends - 1, first)), n, sums) for n in HEADS], axis=1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, grams.size + 1, len(HEADS), dtype=np.int32)), pa.array(signed(np.ascontiguousarray(grams.reshape(-1)))))
    return pa.RecordBatch.from_arrays([b.column("block_id"), lists.cast(schema.field(1).type)], schema=schema)


def goes_on(ends_page: DataFrame, body: DataFrame, most: int = CONTEXTS) -> DataFrame:
    """ends_page(block_id, head of the next page's first body block) -> the block_ids whose text goes on there: the head starts
    in lower case, or what it starts with stands more often inside sentences than at the start of one, as the longest run of
    its first characters that stands anywhere MIN_ENDS times tells."""
    heads = cut_lineage(map_arrow(ends_page.select("block_id", "head"), _heads, "block_id bigint, grams array<bigint>"))
    each = heads.select("block_id", F.posexplode("grams").alias("order", "key"))
    counts = _counted(body, each.select("key").distinct(), _words, most)
    best = each.join(counts.filter(F.col("n") + F.col("m") >= MIN_ENDS), "key").groupBy("block_id").agg(F.max(F.struct("order", "n", "m")).alias("best"))
    first = F.left(F.regexp_replace("head", r"^[^\p{L}\p{N}]+", ""), F.lit(1))
    lower = ends_page.filter((first == F.lower(first)) & (first != F.upper(first))).select("block_id")
    return lower.union(best.filter("best.m > best.n").select("block_id"))


def context_counts(body: DataFrame, tails: DataFrame, most: int = CONTEXTS) -> DataFrame:
    """(key, at_end, within) of the contexts that recur as an end: how often they end a text and how often they stand inside."""
    ends = tails.select(F.explode("grams").alias("key")).groupBy("key").agg(F.count("*").alias("at_end")).filter(F.col("at_end") >= MIN_ENDS)
    ends = cut_lineage(ends)
    inner = _counted(body, ends, _inner, most)
    return ends.join(inner.select("key", F.col("n").alias("within")), "key", "left").fillna(0, ["within"])


def scored_tails(tails: DataFrame, counts: DataFrame) -> DataFrame:
    """The tails with the log-odds of their longest context that recurs; of a tail without any, -6. A cut's mark takes 2."""
    each = tails.select("block_id", F.posexplode("grams").alias("order", "key"))
    odds = F.log((F.col("at_end") + 0.5) / (F.col("within") + 0.5))
    longest = each.join(counts.select("key", odds.alias("odds")), "key").groupBy("block_id").agg(F.max(F.struct("order", "odds")).alias("best"))
    out = tails.drop("grams").join(longest, "block_id", "left")
    return out.withColumn("log_odds", F.coalesce("best.odds", F.lit(-6.0)) - F.when(F.col("mark"), 2.0).otherwise(0.0)).drop("best", "mark")


def best_split(counts: list[tuple[float, int]], low: float = -3.0, high: float = -0.5) -> float:
    """Otsu's threshold of a histogram [(value, n)], kept within [low, high]."""
    counts = sorted(counts)
    total = sum(n for _, n in counts)
    mean = sum(v * n for v, n in counts) / max(total, 1)
    best, at, n0, s0 = -1.0, low, 0, 0.0
    for (v, n), (after, _) in zip(counts, counts[1:], strict=False):
        n0, s0 = n0 + n, s0 + v * n
        if n0 and n0 < total:
            between = (mean * n0 - s0) ** 2 / (n0 * (total - n0))
            if between > best:
                best, at = between, (v + after) / 2
    return min(max(at, low), high)


def cut_blocks(blocks: DataFrame, pages: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """blocks, page_info -> (block_id, book_id, page_index, type, lang, log_odds) of the body blocks that were cut. `texts` are
    those of problem 2, over whose sources messages must recur to be its cases; without them no message is."""
    blocks = blocks.filter("content is not null and block_id is not null")
    body = blocks.filter(is_body())
    narrow = body.select("block_id", "book_id", "page_index", "block_pos", "type", "content")
    narrow = narrow.withColumn("line", F.xxhash64("book_id", letters(F.substring_index(F.rtrim("content"), "\n", -1))))
    ddl = "block_id bigint, book_id string, page_index int, block_pos int, type string, line bigint, mark boolean, said array<bigint>, grams array<bigint>"
    tails = cut_lineage(map_arrow(narrow, _tails, ddl).dropDuplicates(["block_id"]))
    scored = scored_tails(tails, context_counts(body, tails))
    langs = pages.select("book_id", "page_index", F.lower("src_lang").alias("lang")).dropDuplicates(["book_id", "page_index"])
    scored = cut_lineage(scored.join(langs, ["book_id", "page_index"], "left").withColumn("lang", F.coalesce("lang", F.lit("und"))))
    histogram = scored.groupBy("lang", "type", (F.floor(F.col("log_odds") * 4) / 4).alias("v")).count().collect()  # languages x 4 x at most 200 steps
    by: dict = {}
    for r in histogram:
        by.setdefault((r["lang"], r["type"]), []).append((float(r["v"]), r["count"]))
    limits = [(lang, kind, best_split(c)) for (lang, kind), c in by.items()]
    thresholds = scored.sparkSession.createDataFrame(limits, "lang string, type string, limit double")
    low = scored.join(F.broadcast(thresholds), ["lang", "type"]).filter(F.col("log_odds") < F.col("limit"))
    furniture = blocks.filter(F.col("type").isin("header", "footer", "number") & (letters(F.col("content")) != "")).select(F.xxhash64("book_id", letters(F.col("content"))).alias("line"))
    again = scored.groupBy("line", "page_index").count().groupBy("line").count().filter(F.col("count") >= MIN_PAGES).select("line")
    low = cut_lineage(low.join(furniture.union(again).distinct(), "line", "left_anti"))
    if texts is not None and not low.filter(F.size("said") > 0).isEmpty():
        low = cut_lineage(low.join(_residue(low, texts), "block_id", "left_anti"))

    body = body.filter(F.trim("content") != "")
    head = F.left(F.ltrim("content"), F.lit(HEAD))
    starts = body.groupBy("book_id", "page_index").agg(F.min(F.struct("block_pos", head.alias("head"))).alias("s"), F.max("block_pos").alias("last"))
    starts = cut_lineage(starts.select("book_id", "page_index", "last", "s.head"))
    ahead = starts.select("book_id", (F.col("page_index") - 1).alias("page_index"), "head")
    ends_page = low.join(starts.select("book_id", "page_index", "last"), ["book_id", "page_index"]).filter(F.col("block_pos") == F.col("last")).join(ahead, ["book_id", "page_index"])
    going_on = goes_on(cut_lineage(ends_page.select("block_id", "head")), body)

    formulas = blocks.filter("type = 'formula'").select("book_id", "page_index", F.col("block_pos").alias("after")).distinct()
    nearest = blocks.filter("type <> 'formula_number' and type <> 'number'").select("book_id", "page_index", "block_pos")
    leads = low.join(formulas, ["book_id", "page_index"]).filter("after > block_pos")
    leads = leads.groupBy("block_id", "book_id", "page_index", "block_pos").agg(F.min("after").alias("after"))
    between = leads.withColumnRenamed("block_pos", "pos").join(nearest, ["book_id", "page_index"]).filter("block_pos > pos and block_pos < after").select("block_id")
    leads = leads.join(between.distinct(), "block_id", "left_anti").select("block_id")
    return low.join(going_on.union(leads), "block_id", "left_anti").select("block_id", "book_id", "page_index", "type", "lang", "log_odds")


def _residue(low: DataFrame, texts: DataFrame) -> DataFrame:
    """The blocks that hold a message of problem 2. Only messages are counted: other units can't be in these blocks' lists."""
    from .p2_residue import CANDIDATE, MIN_SOURCES, _scan

    found = map_arrow(texts.select("record_kind", "record_id", "block_pos", "source", "content"), _scan, CANDIDATE).filter(~F.col("placeholder"))
    wide = found.groupBy("message_id").agg(F.countDistinct("source").alias("sources")).filter(F.col("sources") >= MIN_SOURCES)
    return low.select("block_id", F.explode("said").alias("message_id")).join(wide, "message_id", "left_semi").select("block_id").distinct()


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .p2_residue import texts

    return cut_blocks(table(spark, sf_dir, "blocks"), table(spark, sf_dir, "page_info"), texts(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir).select("block_id").distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source: its body blocks, the share that was cut, its pages, those with a cut, those reported as truncated,
    and those of which both holds. A null `truncated` counts as not reported."""
    cut = cut_lineage(_cut(spark, sf_dir))
    body = table(spark, sf_dir, "blocks").filter(is_body()).select("block_id", "book_id", "page_index").distinct()
    per_page = body.groupBy("book_id", "page_index").agg(F.count("*").alias("blocks"))
    per_page = per_page.join(cut.groupBy("book_id", "page_index").agg(F.count("*").alias("cut")), ["book_id", "page_index"], "left").fillna(0, ["cut"])
    results = table(spark, sf_dir, "page_results").select("result_id", "book_id", "page_index", F.regexp_replace(F.lower(F.trim("source")), "-", "_").alias("source"), "truncated")
    results = results.dropDuplicates(["result_id"]).join(per_page, ["book_id", "page_index"], "left").fillna(0, ["blocks", "cut"])
    said = F.coalesce("truncated", F.lit(False))
    return results.groupBy("source").agg(
        F.sum("blocks").alias("blocks"), F.sum("cut").alias("cut_blocks"), (F.sum("cut") / F.greatest(F.sum("blocks"), F.lit(1))).alias("cut_share"),
        F.count("*").alias("pages"), F.sum((F.col("cut") > 0).cast("long")).alias("pages_with_cut"), F.sum(said.cast("long")).alias("pages_reported"),
        F.sum((said & (F.col("cut") > 0)).cast("long")).alias("pages_both"),
    )


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
SQL: dict[str, str] = {}

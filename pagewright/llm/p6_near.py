"""Problem 6: near-duplicate blocks (likeness of 3-word shingle sets of at least 0.6), in a collection too large for pairs.

Method: an inverted index over prefixes, which is exact. All shingles have one order, the rarer first; a block of n distinct
shingles indexes its first n - ceil(LIKENESS * n) + 1. Two blocks alike to LIKENESS share at least that part of either, so the
first shingle that they share in that order lies in both prefixes and they meet, whatever words an edit brings in. The order
only decides how many strangers meet: by how often all blocks hold the shingle (counted in BUCKETS buckets of hashes, so that
a count is at worst too high), then by the frequencies of its words over the whole corpus, then by hash. Of two blocks the
smaller shares at least 2t/(1+t) of its shingles, so of its prefix n - ceil(2t/(1+t) n) + 1 will do. A row of the index holds
the block's complete fingerprint, 32 min-hashes of four bits, which also stands for the block: strangers end where they meet
(3.3 standard deviations allowed: a pair at exactly 0.6 is lost with 5e-4), and only what is left is shuffled on and verified by
the likeness of the whole shingle sets.

Multi-index hashing of fingerprints of bits can't do it at this threshold: 64-bit simhashes of such pairs differ in about 15
bits, for which a quarter of 16 bits needs balls of radius 3 (697 probes, each meeting rows/65536 strangers).

Copies (equal word sequences) are one class with one fingerprint, so a class that holds a third of all rows has one row a batch
in the index and meets others once; only the answer's pairs are expanded. Nulls, empty texts and texts under 30 words belong to
no pair; a redelivered block counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, cut_lineage, frequent_words, map_arrow, prefilter, slices, strings, table
from .vec import Words, mix, signed

MIN_WORDS = 30
SHINGLE = 3
LIKENESS = 0.6
#: Words with at least this share of all words count as frequent: at most 50,000 words in any corpus.
FREQUENT_SHARE = 2e-5
#: Shingles are counted in so many buckets of hashes, which are summed in so many parts.
BUCKETS, PARTS = 1 << 22, 64


def _levels(counts: np.ndarray) -> np.ndarray:
    """The binary logarithm of counts, from 1."""
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.uint64) + np.uint64(1)


def _looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each key, 0 where it isn't among the (sorted) known ones."""
    out = np.zeros(len(keys), dtype=np.uint64)
    if len(known):
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        out[hit] = values[at[hit]]
    return out


def prefix_length(n: np.ndarray, likeness: float) -> np.ndarray:
    """How many of a block's n shingles are indexed; 1e-9 so that rounding can only lengthen a prefix."""
    return n - np.ceil(likeness * n - 1e-9).astype(np.int64) + 1


def _fingerprints(words: tuple, shingle_level: np.ndarray, min_words: int, likeness: float):
    word_level = _levels(words[1])

    def run(whole: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        parts = [one(b, schema) for b in slices(whole, "content")]
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if any(p.num_rows for p in parts) else parts[0]

    def one(b: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        w = Words(strings(b.column("content")))
        n_words = np.diff(w.first)
        g, first = w.grams(SHINGLE)
        keep = n_words[w.row[first]] >= min_words if len(first) else np.zeros(0, bool)
        g, first = g[keep], first[keep]
        row = w.row[first]
        rare = _looked_up(w.hash, words[0], word_level)
        three = [rare[first + j] for j in range(SHINGLE)]
        plain = np.minimum.reduce(three) > 0  # no rare word in it
        least = (shingle_level[_bucket(g)].astype(np.uint64) << np.uint64(9)) + sum(three) + np.where(plain, np.uint64(200), np.uint64(0))
        order = np.lexsort((g, least, row))
        g, row = g[order], row[order]
        fresh = np.ones(len(g), dtype=bool)
        fresh[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        g, row = g[fresh], row[fresh]  # distinct shingles
        sizes = np.bincount(row, minlength=b.num_rows)
        rows = np.flatnonzero(n_words >= min_words)
        start = np.searchsorted(row, np.arange(b.num_rows))
        sketch = sketches(g, start[rows])
        seq, _ = whole_hash(w, rows)
        once = np.zeros(b.num_rows, dtype=bool)  # of copies the first is indexed
        once[rows[np.unique(seq, return_index=True)[1]]] = True
        rank = np.arange(len(g)) - start[row]
        used = (rank < prefix_length(sizes, likeness)[row]) & once[row]
        short = np.minimum(prefix_length(sizes, 2 * likeness / (1 + likeness)), prefix_length(sizes, likeness))
        key_row = row[used]
        key = packed(mix(g[used]), sizes[key_row], rank[used] < short[key_row])
        first_key = np.searchsorted(key_row, np.append(rows, b.num_rows))
        lists = pa.ListArray.from_arrays(pa.array(first_key.astype(np.int32)), pa.array(key))
        return pa.RecordBatch.from_arrays([b.column("block_id").take(pa.array(rows)), pa.array(signed(seq)), pa.array(sizes[rows].astype(np.int32)), *map(pa.array, sketch), lists.cast(schema.field(5).type)], schema=schema)

    return run


def _bucket(g: np.ndarray) -> np.ndarray:
    return (mix(g) >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def _parts(counts: dict[int, np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return batch(schema, list(counts), [pa.compress(n.tobytes(), "zstd", asbytes=True) for n in counts.values()])


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How many shingles of all texts fall in each bucket, summed within each partition before the shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = "part int, counts binary"
    schema, each = to_arrow_schema(StructType.fromDDL(ddl)), BUCKETS // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for whole in batches:
            for b in slices(whole, "content"):
                u, n = np.unique(_bucket(Words(strings(b.column("content"))).grams(SHINGLE)[0]), return_counts=True)
                total[u] += n
        yield _parts({k: part for k, part in enumerate(total.reshape(PARTS, each)) if part.any()}, schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, packed_counts in zip(b.column("part").to_pylist(), b.column("counts"), strict=True):
                n = np.frombuffer(pa.decompress(packed_counts.as_buffer(), 8 * each, "zstd"), dtype=np.int64)
                total[k] = total[k] + n if k in total else n
        yield _parts(total, schema)

    out = np.zeros((PARTS, each), dtype=np.int64)
    for row in texts.select("content").mapInArrow(count, ddl).repartition("part").mapInArrow(add, ddl).collect():
        out[row["part"]] = np.frombuffer(pa.decompress(row["counts"], 8 * each, "zstd"), dtype=np.int64)
    return out.ravel()


def shingle_levels(counts: np.ndarray) -> np.ndarray:
    """The binary logarithm of each bucket's count, from 1; 0 for what chance may have brought together: half a mean bucket."""
    least = max(1.0, counts.mean() / 2)
    return np.where(counts >= least, np.floor(np.log2(np.maximum(counts / least, 1))) + 1, 0).astype(np.uint8)


#: Odd factors that order the shingles in 32 unlike ways.
ORDERS = mix(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)


def sketches(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two longs for each row of shingle hashes: 32 min-hashes of four bits, the row's complete fingerprint."""
    out = []
    for half in range(2):
        bits = np.zeros(len(first), dtype=np.uint64)
        for k in range(16):
            factor = ORDERS[16 * half + k]
            with np.errstate(over="ignore"):
                turned = g * factor
                low = np.minimum.reduceat((turned ^ (turned >> np.uint64(31))) * factor, first) if len(first) else np.zeros(0, np.uint64)
            bits |= (mix(low) & np.uint64(15)) << np.uint64(4 * k)
        out.append(signed(bits))
    return out[0], out[1]


def _agreements(a: str, b: str):
    """How many of 16 four-bit symbols two longs have in common."""
    x = F.col(a).bitwiseXOR(F.col(b))
    x = x.bitwiseOR(F.shiftright(x, 1))
    x = x.bitwiseOR(F.shiftright(x, 2))
    return F.lit(16) - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same of arrays."""
    x = (a ^ b).view(np.uint64)
    x = x | (x >> np.uint64(1))
    x = x | (x >> np.uint64(2))
    return 16 - np.bitwise_count(x & np.uint64(0x1111111111111111)).astype(np.int64)


def least_agreements(likeness: float, symbols: int = 32, bits: int = 4, deviations: float = 3.3) -> int:
    """Of so many symbols; so many standard deviations under what a pair of this likeness is expected to have."""
    p = likeness + (1 - likeness) / 2**bits
    return int(symbols * p - deviations * (symbols * p * (1 - p)) ** 0.5)


#: A row of the index is a long and the fingerprint. From its top the long has 52 bits of the shingle's hash, the block's size
#: in steps of 1 %, and a 0 if the shingle is in the shorter prefix that the smaller block of a pair needs, so that in order
#: the rows of a shingle follow each other by size.
SIZE_BITS, SIZE_STEP = 11, 1.01
LOW = np.int64((1 << SIZE_BITS + 1) - 1)


def packed(key: np.ndarray, size: np.ndarray, short: np.ndarray) -> np.ndarray:
    step = np.minimum(np.log(size) / np.log(SIZE_STEP), (1 << SIZE_BITS) - 1).astype(np.int64)
    return (signed(key) & ~LOW) | (step << 1) | ~short


def _furthest(row: np.ndarray, likeness: float) -> np.ndarray:
    """The last row of the same shingle whose block may be alike to this row's, by its size. Errs on the side of yes."""
    steps = int(np.ceil(np.log(1 / likeness) / np.log(SIZE_STEP))) + 1
    return (row & ~LOW) | np.minimum((row & LOW) + 2 * steps | 1, LOW)


def _meetings(likeness: float, rows: int = 500_000, at_once: int = 1_000_000):
    """(row, f, g) of the index in order -> (f_a, g_a, f_b, g_b) of blocks that share a shingle and may be alike. Only rows that
    later ones may still meet are held: those of the last shingle, of a size not too far behind."""
    least = least_agreements(likeness)

    def met(held: np.ndarray, new: np.ndarray) -> Iterator[np.ndarray]:
        every = np.concatenate([held, new], axis=1)
        low = every[0]
        # The smaller block comes first; of the same step of size those do whose shingle is in their shorter prefix.
        a = np.flatnonzero(low & 1 == 0)
        start = np.maximum(a + 1, held.shape[1])
        count = np.searchsorted(low, _furthest(low[a], likeness), side="right") - start
        a, start, count = (x[count > 0] for x in (a, start, count))
        upto = np.cumsum(count)
        for begin in range(0, int(upto[-1]) if len(upto) else 0, at_once):
            pair = np.arange(begin, min(begin + at_once, int(upto[-1])))
            of = np.searchsorted(upto, pair, side="right")
            x, y = every[1:, a[of]], every[1:, start[of] + pair - (upto - count)[of]]
            alike = sum(agreements(x[k], y[k]) for k in range(2)) >= least
            x, y = x[:, alike], y[:, alike]
            turned = (x[0] > y[0]) | ((x[0] == y[0]) & (x[1] > y[1]))
            both = np.vstack([np.where(turned, y, x), np.where(turned, x, y)])
            both = both[:, (both[:2] != both[2:]).any(axis=0)]
            if both.shape[1]:
                yield np.unique(both, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, n = np.zeros((3, 0), dtype=np.int64), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting, n
            new = np.concatenate(waiting, axis=1)
            waiting, n = [], 0
            for both in met(held, new):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in both], names=["f_a", "g_a", "f_b", "g_b"])
            every = np.concatenate([held, new], axis=1)
            held = every[:, (every[0] & 1 == 0) & (_furthest(every[0], likeness) >= new[0, -1])]

        last = None
        for b in batches:
            if b.num_rows == 0:
                continue
            r = np.stack([b.column(c).to_numpy() for c in ("row", "f", "g")])
            before = np.concatenate([r[:, :1] if last is None else last, r[:, :-1]], axis=1)
            fresh = (r != before).any(axis=0)  # copies that other batches indexed
            fresh[0] |= last is None
            last = r[:, -1:]
            waiting.append(r[:, fresh])
            n += int(fresh.sum())
            if n >= rows:
                yield from flush()
        if n:
            yield from flush()

    return run


def whole_hash(w: Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One hash for the word sequence of each row."""
    n = len(w.hash)
    with np.errstate(over="ignore"):
        place = np.arange(n, dtype=np.uint64) - w.first[w.row].astype(np.uint64) if n else np.zeros(0, np.uint64)
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(w.hash + mix(place)), dtype=np.uint64)])
        out = mix(total[w.first[rows + 1]] - total[w.first[rows]] + (w.first[rows + 1] - w.first[rows]).astype(np.uint64))
    return out, rows


def _likeness(b: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    keep = []
    for part in slices(b, "content_a", 400_000):
        sets = []
        for side in ("content_a", "content_b"):
            w = Words(strings(part.column(side)))
            g, first = w.grams(SHINGLE)
            row = w.row[first]
            order = np.lexsort((g, row))
            g, row = g[order], row[order]
            fresh = np.ones(len(g), dtype=bool)
            fresh[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
            sets.append((row[fresh], g[fresh]))
        (ra, ga), (rb, gb) = sets
        row, g = np.concatenate([ra, rb]), np.concatenate([ga, gb])
        order = np.lexsort((g, row))
        row, g = row[order], g[order]
        twice = (g[1:] == g[:-1]) & (row[1:] == row[:-1])
        both = np.bincount(row[1:][twice], minlength=part.num_rows)
        either = np.bincount(ra, minlength=part.num_rows) + np.bincount(rb, minlength=part.num_rows) - both
        keep.append(np.where(either > 0, both / np.maximum(either, 1), 0.0))
    return batch(schema, b.column("a"), b.column("b"), np.concatenate(keep))


def classes_and_links(blocks: DataFrame, likeness: float = LIKENESS, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """blocks(block_id, content) -> (members(block_id, class), links(a, b, likeness) between different classes, a < b)."""
    texts = blocks.select("block_id", "content").filter("content is not null and block_id is not null")
    fingerprints = _fingerprints(frequent_words(texts, "content", FREQUENT_SHARE), shingle_levels(shingle_counts(texts)), min_words, likeness)
    prints = cut_lineage(map_arrow(texts, fingerprints, "block_id bigint, class bigint, n int, f bigint, g bigint, rows array<bigint>"))
    index = prints.select(F.explode("rows").alias("row"), "f", "g").repartition(F.shiftright("row", SIZE_BITS + 1)).sortWithinPartitions("row", "f", "g")
    met = cut_lineage(index.mapInArrow(_meetings(likeness), "f_a bigint, g_a bigint, f_b bigint, g_b bigint").distinct())
    whole = prints.select("class", "n", "f", "g").distinct()
    same = whole.groupBy("f", "g").count().filter("count > 1").select(F.col("f").alias("f_a"), F.col("g").alias("g_a"), F.col("f").alias("f_b"), F.col("g").alias("g_b"))
    found = met.unionAll(same)
    for side in "ab":
        found = found.join(whole.withColumnsRenamed({"class": side, **{c: f"{c}_{side}" for c in ("n", "f", "g")}}), [f"f_{side}", f"g_{side}"])
    found = found.filter((F.col("a") < F.col("b")) | (F.col("f_a") != F.col("f_b")) | (F.col("g_a") != F.col("g_b")))
    found = found.filter(F.least("n_a", "n_b") >= likeness * F.greatest("n_a", "n_b") - 1e-9)
    pairs = cut_lineage(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    reps = cut_lineage(prints.select("block_id", "class").join(wanted, "class", "left_semi").groupBy("class").agg(F.min("block_id").alias("block_id")))
    contents = cut_lineage(prefilter(texts, "block_id", reps).join(reps, "block_id").dropDuplicates(["class"]).select("class", "content"))
    full = pairs.join(contents.withColumnsRenamed({"class": "a", "content": "content_a"}), "a").join(contents.withColumnsRenamed({"class": "b", "content": "content_b"}), "b")
    links = map_arrow(full.select("a", "b", "content_a", "content_b"), _likeness, "a bigint, b bigint, likeness double").filter(F.col("likeness") >= likeness)
    return prints.select("block_id", "class").distinct(), links


def near_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "blocks").filter(~F.col("type").isin("table", "formula") | F.col("type").isNull())


def pairs_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of blocks: within a class and across linked classes, the lower id first."""
    crowded = members.groupBy("class").count().filter("count > 1").select("class")
    many = members.join(crowded, "class", "left_semi")
    inside = many.withColumnRenamed("block_id", "x").join(many.withColumnRenamed("block_id", "y"), "class").filter("x < y").select("x", "y")
    across = (
        links.select("a", "b")
        .join(members.withColumnsRenamed({"class": "a", "block_id": "x"}), "a")
        .join(members.withColumnsRenamed({"class": "b", "block_id": "y"}), "b")
        .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    )
    return inside.unionAll(across).filter("x <> y").withColumnsRenamed({"x": "block_id_a", "y": "block_id_b"})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = classes_and_links(near_blocks(spark, sf_dir))
    return pairs_of(cut_lineage(members), cut_lineage(links))


def components(links: DataFrame) -> DataFrame:
    """(class, group): the least class of each connected component, by alternating large and small stars until nothing changes."""
    edges = cut_lineage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        new = cut_lineage(small)
        changed = new.exceptAll(edges).limit(1).count() + edges.exceptAll(new).limit(1).count()
        edges = new
        if not changed:
            break
    return edges.select(F.col("b").alias("class"), F.col("a").alias("group")).unionAll(edges.select(F.col("a").alias("class"), F.col("a").alias("group"))).distinct()


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per block that is alike to another: its class of copies, its group and its class's links to other classes."""
    members, links = classes_and_links(near_blocks(spark, sf_dir))
    members, links = cut_lineage(members), cut_lineage(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    size = members.groupBy("class").agg(F.count("*").alias("copies"))
    out = members.join(size, "class").join(degree, "class", "left").join(components(links), "class", "left")
    return out.filter("copies > 1 or links is not null").select("block_id", F.col("class").alias("class_id"), F.coalesce("group", "class").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}
SQL: dict[str, str] = {
    "p6_found": r"""
WITH w AS (SELECT block_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS ws
           FROM (SELECT DISTINCT block_id, content FROM blocks WHERE type NOT IN ('table', 'formula') AND content IS NOT NULL)),
s AS (SELECT DISTINCT block_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i) WHERE len(ws) >= 30),
n AS (SELECT block_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.block_id AS x, b.block_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.block_id < b.block_id GROUP BY 1, 2)
SELECT x AS block_id_a, y AS block_id_b FROM p JOIN n m ON m.block_id = x JOIN n o ON o.block_id = y WHERE shared >= 0.6 * (m.n + o.n - shared)
"""
}

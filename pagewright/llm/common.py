"""What the problems' operators share: tables, column types of blocks, and Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.session import cut_lineage, ensure_checkpoint_dir, table  # noqa: F401

BODY = ["text", "content", "abstract", "aside_text"]


def is_body() -> Column:
    return F.col("type").isin(BODY)


def letters(text: Column) -> Column:
    """A text's letters in lower case and order: what makes two lines the same."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", "")


def strings(column: pa.Array | pa.ChunkedArray) -> list[str | None]:
    return column.to_pylist()


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def map_arrow(df: DataFrame, function, ddl: str) -> DataFrame:
    """mapInArrow with the output's Arrow schema as the function's second argument; empty batches are skipped."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = function(b, schema)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, ddl)


def nested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks nested in service pages, one row each; a redelivered page's blocks come again."""
    return table(spark, sf_dir, "service_pages").select("service_page_id", "book_id", F.posexplode("blocks").alias("block_pos", "b"))


def slices(b: pa.RecordBatch, column: str, most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `most` bytes of text each (a longer text is a part of its own)."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < b.num_rows:
        upto = int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right"))
        upto = max(1, upto)
        yield b.slice(at, upto)
        at += upto


def count_by_partition(df: DataFrame, column: str, counts, flush: int = 1_000_000) -> DataFrame:
    """(key, n) of `counts(texts) -> (keys, counts)` over all texts, summed within each partition before the shuffle."""
    import numpy as np
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = "key bigint, n bigint"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def merged(keys: list, ns: list) -> tuple:
        u, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(u), dtype=np.int64)
        np.add.at(total, at, np.concatenate(ns))
        return u, total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        ns: list = []
        held = 0
        for whole in batches:
            for b in slices(whole, column):
                k, n = counts(strings(b.column(column)))
                keys.append(k)
                ns.append(n)
                held += len(k)
                if held > flush:
                    u, total = merged(keys, ns)
                    keys, ns, held = [u], [total], len(u)
                    if held > flush // 2:
                        yield batch(schema, u.view(np.int64), total)
                        keys, ns, held = [], [], 0
        if keys:
            u, total = merged(keys, ns)
            yield batch(schema, u.view(np.int64), total)

    return df.select(column).mapInArrow(run, ddl).groupBy("key").agg(F.sum("n").alias("n"))


def frequent_words(df: DataFrame, column: str, share: float, also: str = ""):
    """Hashes (sorted) and counts of the words that make up at least `share` of all words of the column: at most 1/share of
    them whatever the corpus, which bounds what the driver holds and sends out."""
    import numpy as np

    from .vec import Words

    def counts(texts: list) -> tuple:
        u, n = np.unique(Words(texts, also).hash, return_counts=True)
        return u, n.astype(np.int64)

    every = count_by_partition(df, column, counts)
    rows = every.filter(F.col("n") >= every.agg(F.sum("n") * share).scalar()).toArrow()
    keys = rows.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows.column("n").to_numpy()[order].astype(np.int64)


def prefilter(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of `df` whose `column` is in `ids(column)`, and a few others: a bitmap of 2**24 hashed ids, sent out as at most
    2**18 words whatever the number of ids, so it saves less the more there are, but never more is sent. An exact join follows."""
    parts = ["shiftrightunsigned(xxhash64({0}), 46) as _word", "shiftleft(1L, cast(xxhash64({0}) & 63 as int)) as _bit"]
    bitmap = ids.selectExpr(*(x.format(column) for x in parts)).groupBy("_word").agg(F.bit_or("_bit").alias("_mask"))
    there = df.selectExpr("*", *(x.format(column) for x in parts)).join(F.broadcast(bitmap), "_word")
    return there.filter(F.col("_mask").bitwiseAND(F.col("_bit")) != 0).drop("_word", "_bit", "_mask")


def bitmap(ids: DataFrame, column: str):
    """2**24 bits of the hashes `column`, as 2**18 words whatever their number: for `in_bitmap`."""
    import numpy as np

    parts = ids.selectExpr(f"shiftrightunsigned({column}, 46) as word", f"shiftleft(1L, cast({column} & 63 as int)) as bit")
    rows = parts.groupBy("word").agg(F.bit_or("bit").alias("mask")).toArrow()
    out = np.zeros(1 << 18, dtype=np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_bitmap(bits, keys):
    """Which of the hashes may be among those of `bitmap`."""
    import numpy as np

    return (bits[(keys >> np.uint64(46)).astype(np.int64)] >> (keys & np.uint64(63))) & np.uint64(1) == 1

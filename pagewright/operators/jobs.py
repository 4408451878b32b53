"""Scheduling as relations: which page next, which book next, and how often a job has failed in a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STRIKES = 3
COOLDOWN_SECONDS = 15


def ring(pages: DataFrame, start: Column, most: int) -> DataFrame:
    """Of each book's pages the first `most`, counted round from `start` and on from the first page after the last."""
    total = F.max("page_index").over(W.partitionBy("book_id"))
    p = pages.withColumn("step", F.pmod(F.col("page_index") - start, total))
    return p.withColumn("place", F.row_number().over(W.partitionBy("book_id").orderBy("step"))).filter(F.col("place") <= most)


def strikes(jobs: DataFrame) -> DataFrame:
    """jobs(seq, book_id, kind, ok) -> the failures since the last success, at each job and not only at the end."""
    w = W.partitionBy("book_id", "kind").orderBy("seq")
    island = jobs.withColumn("island", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy("book_id", "kind", "island").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return island.withColumn("strikes", F.sum((~F.col("ok")).cast("int")).over(run)).drop("island")


def pick(work: DataFrame, struck: DataFrame, focus: Column) -> DataFrame:
    """work(book_id, place, needs_translation, needs_ocr) and the books struck out(book_id, kind) -> the jobs to do, by
    `focused` falling and `place` rising; of a book translation before recognition."""
    out = struck.groupBy("book_id").agg(F.bool_or(F.col("kind") == "translate").alias("no_translate"), F.bool_or(F.col("kind") == "ocr").alias("no_ocr"))
    j = work.join(out, "book_id", "left")
    translate = F.col("needs_translation") & ~F.coalesce("no_translate", F.lit(False))
    ocr = F.col("needs_ocr") & ~F.coalesce("no_ocr", F.lit(False))
    j = j.withColumn("kind", F.when(translate, "translate").when(ocr, "ocr")).filter("kind is not null")
    return j.select("book_id", "kind", focus.alias("focused"), "place")


def cooldown(events: DataFrame, seconds: int = COOLDOWN_SECONDS) -> DataFrame:
    """events(seq, ts, limited) -> whether a job at `ts` has to wait for an earlier rate limit to pass. Time is cut into
    buckets as long as the wait, so only the own and the last bucket's limits count: two equi-joins, no global order."""
    bucket = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000)).cast("bigint")
    e = events.withColumn("bucket", bucket(F.col("ts")))
    limits = e.filter("limited").groupBy("bucket").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    j = e.join(limits.select("bucket", "first"), "bucket", "left").join(limits.select((F.col("bucket") + 1).alias("bucket"), F.col("last").alias("before")), "bucket", "left")
    near = (F.col("first") < F.col("ts")) | (F.unix_micros("ts") < F.unix_micros("before") + seconds * 1_000_000)
    return j.withColumn("waits", F.coalesce(near, F.lit(False))).drop("bucket", "first", "before")


def last_lines(log: DataFrame, most: int = 200, *keys: str) -> DataFrame:
    """The ring of log lines: the last `most` of each stream."""
    return log.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("seq")))).filter(F.col("rn") <= most).drop("rn")

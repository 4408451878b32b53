"""Problem 4: lines repeated across one book's pages.

Method: distributed PrefixSpan. A page is a sequence of line ids in reading order, a book is a source, support is the number
of distinct pages. Level 1 counts single lines; each further level extends every frequent sequence by the frequent lines
that come after its first occurrence on a page (the projected database, held as one row per page and sequence, never
gathered by book). Then all occurrences of lines of frequent sequences are taken out.

Level by level goes on until no sequence is frequent. For each sequence a page holds one place, that of its first
occurrence's end, and is extended by a line once: by the first place of it after that. Patterns are whole: none is left out.

Lines without letters, null contents and the left-out types yield nothing; a redelivered block counts once, as pages and
(block_id, line_no) are distinct. No book is gathered into one task: support is counted by (book, line, page) first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, letters, table

MIN_PAGES = 5
LEFT_OUT = ["table", "formula", "formula_number", "image", "chart", "algorithm"]


def lines(blocks: DataFrame) -> DataFrame:
    """One row per line with letters: book, page, block_id, line_no, item (the line's letters, hashed) and its place."""
    return (
        blocks.filter(F.col("content").isNotNull() & (~F.col("type").isin(LEFT_OUT) | F.col("type").isNull()))
        .select("block_id", "page_index", "block_pos", F.xxhash64("book_id").alias("book"), F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
        .withColumn("norm", letters(F.col("line")))
        .filter("norm <> ''")
        .select("book", "page_index", "block_id", "line_no", F.xxhash64("norm").alias("item"), (F.coalesce("block_pos", F.lit(0)).cast("long") * 1048576 + F.col("line_no")).alias("place"))
    )


def _support(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct pages for each key; the first step removes repeats of a page before anything is counted."""
    return rows.select(*keys, "page_index").distinct().groupBy(*keys).count().withColumnRenamed("count", "pages")


def prefix_span(blocks: DataFrame, min_pages: int = MIN_PAGES, max_length: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(patterns(book, items, pages), occurrences(book, page_index, block_id, line_no, item, place) of frequent lines)."""
    all_lines = lines(blocks)
    singles = _support(all_lines, "book", "item").filter(F.col("pages") >= min_pages)
    occurs = cut_lineage(all_lines.join(singles.select("book", "item"), ["book", "item"], "left_semi"))
    patterns = singles.select("book", F.array("item").alias("items"), "pages")
    first = occurs.groupBy("book", "page_index", "item").agg(F.min("place").alias("at"))
    steps = occurs.select("book", "page_index", F.col("item").alias("next"), "place").distinct()
    projected = first.select("book", "page_index", F.array("item").alias("items"), "at")
    length = 1
    while max_length is None or length < max_length:
        length += 1
        longer = (
            projected.join(steps, ["book", "page_index"])
            .filter("place > at")
            .groupBy("book", "page_index", F.concat("items", F.array("next")).alias("items"))
            .agg(F.min("place").alias("at"))
        )
        frequent = longer.groupBy("book", "items").count().withColumnRenamed("count", "pages").filter(F.col("pages") >= min_pages)
        frequent = cut_lineage(frequent)
        if frequent.isEmpty():
            break
        patterns = patterns.unionByName(frequent.select("book", "items", "pages"))
        projected = cut_lineage(longer.join(frequent.select("book", "items"), ["book", "items"], "left_semi"))
    return patterns, occurs


def repeated_lines(blocks: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """The occurrences to delete: lines of any frequent sequence, single lines included."""
    patterns, occurs = prefix_span(blocks, min_pages)
    items = patterns.select("book", F.explode("items").alias("item")).distinct()
    return occurs.join(items, ["book", "item"], "left_semi").select("block_id", "line_no").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "blocks"))


def p4_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent line sequences by book: how many there are of each length, and the pages of the most widespread one."""
    patterns, _ = prefix_span(table(spark, sf_dir, "blocks"))
    return patterns.groupBy("book", F.size("items").alias("length")).agg(F.count("*").alias("sequences"), F.max("pages").alias("most_pages"))


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of the blocks that lose lines, without them."""
    blocks = table(spark, sf_dir, "blocks")
    gone = repeated_lines(blocks).groupBy("block_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("content", "\n"), lambda _, i: ~F.array_contains(F.col("gone"), i))
    return blocks.select("block_id", "content").join(gone, "block_id").dropDuplicates(["block_id"]).select("block_id", F.array_join(kept, "\n").alias("content"))


QUERIES = {"p4_found": p4_found, "p4_sequences": p4_sequences, "p4_clean": p4_clean}
_LINES_SQL = """
WITH l AS (
  SELECT b.block_id, b.book_id, b.page_index, CAST(i AS INTEGER) AS line_no,
         regexp_replace(lower(string_split(b.content, chr(10))[i + 1]), '[^\\p{L}]+', '', 'g') AS norm
  FROM (SELECT DISTINCT block_id, book_id, page_index, content FROM blocks
        WHERE content IS NOT NULL AND type NOT IN ('table', 'formula', 'formula_number', 'image', 'chart', 'algorithm')) b,
       unnest(range(len(string_split(b.content, chr(10))))) AS u(i)),
f AS (SELECT book_id, norm FROM l WHERE norm <> '' GROUP BY 1, 2 HAVING count(DISTINCT page_index) >= 5)
"""
SQL = {
    "p4_found": _LINES_SQL + "SELECT DISTINCT l.block_id, l.line_no FROM l JOIN f USING (book_id, norm)",
    "p4_clean": _LINES_SQL
    + """SELECT block_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS content
    FROM (SELECT l.block_id, l.line_no, f.norm IS NOT NULL AS gone, bool_or(f.norm IS NOT NULL) OVER (PARTITION BY l.block_id) AS hit,
                 string_split((SELECT any_value(content) FROM blocks b WHERE b.block_id = l.block_id), chr(10))[l.line_no + 1] AS line
          FROM l LEFT JOIN f USING (book_id, norm))
    WHERE hit GROUP BY block_id""",
}

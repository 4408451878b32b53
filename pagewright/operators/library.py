"""The library: books, folders, pages and their state. Mutations return the new relations; `sources.bound` writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions.text import is_blank, trim

MAX_PAGES = 20_000


def open_books(books: DataFrame, pages: DataFrame) -> DataFrame:
    """Every book with its pages' counts; a book that isn't bound is Pending and has no pages."""
    bound = F.col("bind").isNotNull()
    sums = pages.groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("pages"), F.count_if("finished").alias("finished"))
    j = books.join(sums, "id", "left")
    return j.select("id", "name", F.when(bound, F.col("status")).otherwise("Pending").alias("status"), F.when(bound, F.coalesce("pages", F.lit(0))).otherwise(0).alias("pages"), F.when(bound, F.coalesce("finished", F.lit(0))).otherwise(0).alias("finished"))


def next_status(books: DataFrame, pages: DataFrame) -> DataFrame:
    """Finished once there is a page and all are; Pending turns to Processing otherwise; else as it was."""
    sums = pages.groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("n"), F.bool_and("finished").alias("all_done"))
    j = books.join(sums, "id", "left")
    return j.select("id", "status", F.when((F.col("n") > 0) & F.col("all_done"), "Finished").when(F.col("status") == "Pending", "Processing").otherwise(F.col("status")).alias("next_status"))


def skeleton(counts: DataFrame) -> DataFrame:
    """counts(id, pages) -> an unfinished page for each; more than MAX_PAGES is an error."""
    n = F.when(F.col("pages") > MAX_PAGES, F.raise_error(F.lit("too many pages"))).otherwise(F.col("pages")).cast("int")
    return counts.filter("pages > 0").select("id", F.explode(F.sequence(F.lit(1), n)).alias("page_index"), F.lit(False).alias("finished"), F.lit(False).alias("translated"))


def patch_pages(pages: DataFrame, updates: DataFrame) -> DataFrame:
    """pages with new recognition: updates(book_id, page_index, blocks) set finished and clear translated; an update of a page
    that isn't there is ignored, of two the later `version` wins."""
    last = updates.withColumn("rn", F.row_number().over(W.partitionBy("book_id", "page_index").orderBy(F.desc("version")))).filter("rn = 1")
    j = pages.join(last.select("book_id", "page_index", F.lit(True).alias("hit"), "version"), ["book_id", "page_index"], "left")
    return j.select("book_id", "page_index", (F.col("finished") | F.col("hit").isNotNull()).alias("finished"), F.when(F.col("hit").isNotNull(), False).otherwise(F.coalesce("translated", F.lit(False))).alias("translated"), F.col("hit").isNotNull().alias("touched"))


def persist_batch(pages: DataFrame, blocks: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, blocks, touched pages) after a batch: updates(book_id, page_index, version, blocks: an array of structs with the
    columns of a block beside its place). The blocks of a touched page are replaced as a whole; a refused page has no update and
    stays as it was."""
    place = ["book_id", "page_index"]
    patched = patch_pages(pages, updates)
    touched = patched.filter("touched").select(*place)
    last = updates.groupBy(*place).agg(F.max_by("blocks", "version").alias("blocks")).join(touched, place, "left_semi")
    new = last.select(*place, F.posexplode("blocks").alias("block_pos", "b")).select(*place, "block_pos", "b.*")
    kept = blocks.join(touched, place, "left_anti")
    return patched.drop("touched"), kept.select(*new.columns).unionByName(new), touched


def prefill(books: DataFrame, pages: DataFrame, counts: DataFrame) -> DataFrame:
    """pages with a skeleton for the books that have none: counts(id, pages) tells how long; books with pages stay."""
    bare = counts.join(books, "id", "left_semi").join(pages.select(F.col("book_id").alias("id")).distinct(), "id", "left_anti")
    return pages.unionByName(skeleton(bare).withColumnRenamed("id", "book_id").select(*pages.columns))


def reset(pages: DataFrame, blocks: DataFrame, which: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, blocks, status) with the books of which(book_id, pages) as at their import: a skeleton of so many pages, or where
    that is 0 of as many as they have, no blocks, Pending. A book of which neither is known is an error."""
    had = pages.groupBy("book_id").agg(F.count("*").alias("had"))
    n = which.join(had, "book_id", "left").select(F.col("book_id").alias("id"), F.when(F.col("pages") > 0, F.col("pages")).otherwise(F.coalesce("had", F.lit(0))).alias("pages"))
    n = n.withColumn("pages", F.when(F.col("pages") == 0, F.raise_error(F.lit("page count unknown"))).otherwise(F.col("pages")))
    fresh = skeleton(n).withColumnRenamed("id", "book_id")
    only = which.select("book_id").distinct()
    status = only.select("book_id", F.lit("Pending").alias("status"))
    return pages.join(only, "book_id", "left_anti").unionByName(fresh.select(*pages.columns)), blocks.join(only, "book_id", "left_anti"), status


def apply_external(blocks: DataFrame, results: DataFrame, external: DataFrame) -> DataFrame:
    """Two kinds of updates of translations: a page's own results, then its neighbour's for it; within a page the neighbour's
    word wins, the later page before the earlier. Both: (book_id, page_index, block_pos, text, by_page)."""
    every = results.withColumn("rank", F.lit(0)).unionByName(external.withColumn("rank", F.lit(1)))
    last = every.groupBy("book_id", "page_index", "block_pos").agg(F.max_by("text", F.struct("rank", "by_page")).alias("new"), F.max("rank").alias("kind"))
    j = blocks.join(last, ["book_id", "page_index", "block_pos"], "left")
    return j.withColumn("translation", F.coalesce("new", "translation")).drop("new")


def folder_error(name: Column) -> Column:
    """Why a folder can't be called so, or null."""
    t = trim(name)
    return F.when(t == "", "empty").when(F.length(t) > 64, "too long").when(t.rlike(r"[/\\]"), "separator").when(t.isin(".", ".."), "reserved")


def by_folder(books: DataFrame, folders: DataFrame) -> DataFrame:
    """Books by folder, empty ones too; a blank or missing folder is the root, an empty name, which sorts first."""
    label = F.when(is_blank(F.col("belong")), F.lit("")).otherwise(trim(F.col("belong")))
    own = books.groupBy(label.alias("folder")).agg(F.count("*").alias("books"), F.min("name").alias("first"))
    every = folders.select(trim(F.col("folder")).alias("folder")).unionByName(own.select("folder")).distinct()
    return every.join(own, "folder", "left").select("folder", F.coalesce("books", F.lit(0)).alias("books"), "first")


def import_books(files: DataFrame, books: DataFrame) -> DataFrame:
    """files(path, name, content) -> their content id and outcome: imported, not a pdf, no name, or already there (in the
    library, or as an earlier file of the same content in this batch)."""
    f = files.withColumn("id", F.substring(F.sha2(F.col("content"), 256), 1, 12))
    f = f.withColumn("copy", F.row_number().over(W.partitionBy("id").orderBy("path")))
    j = f.join(books.select("id", F.lit(True).alias("known")).distinct(), "id", "left")
    outcome = F.when(~F.lower("path").endswith(".pdf"), "not a pdf").when(is_blank(F.col("name")), "no name").when(F.col("known") | (F.col("copy") > 1), "already there").otherwise("imported")
    return j.select("path", "id", outcome.alias("outcome"), F.concat(trim(F.col("name")), F.lit("-"), "id", F.lit(".pdf")).alias("file_name"))


def relative_path_error(path: Column) -> Column:
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.when(path.rlike(r"^(?:/|\\|[A-Za-z]:)"), "absolute").when(F.array_contains(parts, ".."), "leaves the folder").when(is_blank(path), "empty")

"""The library's own files: the repository index, and the bound document of each book, read into relations and written back.

An index is one JSON object with `folders` and `pdfs`. A bound document is one JSON object a book, {status, pages: [{index,
finished, translated, blocks: [{type, content, loc, translation, grid}]}]}. Written, a bound library is a folder a book with
one JSON line a page, so no book has to fit into a task; `read_pages` reads that form, `read_bound` the one-object form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GRID = "struct<cols:int,rows:array<struct<cells:array<struct<text:string,colspan:int>>>>>"
_BLOCK = f"struct<type:string,content:string,loc:array<double>,translation:string,grid:{_GRID}>"
INDEX = "folders array<string>, pdfs array<struct<id:string,name:string,bind:string,belong:string>>"
BOUND = f"status string, pages array<struct<index:int,finished:boolean,translated:boolean,blocks:array<{_BLOCK}>>>"
PAGE = f"status string, index int, finished boolean, translated boolean, blocks array<{_BLOCK}>"


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(folders(name), books(id, name, bind, belong)) of an index file; a file that isn't one stops the reading."""
    whole = spark.read.schema(INDEX).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return whole.select(F.explode("folders").alias("name")), whole.select(F.explode("pdfs").alias("p")).select("p.*")


def _relations(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    flags = [F.coalesce(n, F.lit(False)).alias(n) for n in ("finished", "translated")]
    info = pages.select("book_id", "status", F.col("index").alias("page_index"), *flags)
    blocks = pages.select("book_id", F.col("index").alias("page_index"), F.posexplode("blocks").alias("block_pos", "b"))
    return info, blocks.select("book_id", "page_index", "block_pos", "b.*")


def read_bound(spark: SparkSession, path: str, book: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages(book_id, status, page_index, finished, translated), blocks(book_id, page_index, block_pos, type, content, loc,
    translation, grid)) of bound documents; the book's id is the file's name without its ending, or what `book` makes of
    `_metadata`. Older documents without `translated` have false there."""
    docs = spark.read.schema(BOUND).option("multiLine", True).option("mode", "FAILFAST").json(path)
    name = F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "") if book is None else book
    return _relations(docs.select(name.alias("book_id"), "status", F.explode("pages").alias("p")).select("book_id", "status", "p.*"))


def page_documents(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """pages(book_id, status, page_index, finished, translated), blocks -> (book_id, status, index, finished, translated, blocks):
    the lines to write. Blocks are in the order of `block_pos`; a page without any has an empty list."""
    fields = ["type", "content", "loc", "translation", "grid"]
    of_page = blocks.groupBy("book_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("block_pos", F.struct(*fields).alias("b")))).alias("l"))
    j = pages.join(of_page.select("book_id", "page_index", F.col("l.b").alias("blocks")), ["book_id", "page_index"], "left")
    none = F.from_json(F.lit("[]"), f"array<{_BLOCK}>")
    return j.select("book_id", "status", F.col("page_index").alias("index"), "finished", F.coalesce("translated", F.lit(False)).alias("translated"), F.coalesce("blocks", none).alias("blocks"))


def write_pages(documents: DataFrame, path: str) -> None:
    """Write what `page_documents` gives. It is written beside `path` first and moved there when it is whole: no
    reader meets a library written in part."""
    spark = documents.sparkSession
    staged = f"{path.rstrip('/')}.staged"
    documents.write.mode("overwrite").partitionBy("book_id").option("ignoreNullFields", False).json(staged)
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(target, True)
    if not files.rename(source, target):
        raise OSError(f"could not move {staged} to {path}")


def read_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The relations of a library that `write_pages` wrote."""
    return _relations(spark.read.schema(f"{PAGE}, book_id string").option("mode", "FAILFAST").json(path))

"""Queries on the library, its jobs and the catalog of providers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import catalog as C
from pagewright.operators import jobs as J
from pagewright.operators import library as L
from pagewright.session import shared_folder, table
from pagewright.sources import bound as B
from pagewright.sources.requests import batch_pages

from .views import BLOCKS, blocks, books

FOCUS = "bbd8a716e677"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_info").select("book_id", "page_index", "finished", "translated")


def book_lookup(spark: SparkSession, d: str) -> DataFrame:
    return books(spark, d).filter(F.col("id") == FOCUS).select("id", "name")


def book_open(spark: SparkSession, d: str) -> DataFrame:
    return L.open_books(books(spark, d), _pages(spark, d))


def book_progress(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    return p.groupBy("book_id").agg(F.count_if("finished").alias("finished"), F.count_if(F.coalesce("translated", F.lit(False))).alias("translated"), F.count("*").alias("pages"))


def book_status(spark: SparkSession, d: str) -> DataFrame:
    return L.next_status(books(spark, d), _pages(spark, d))


def book_skeleton(spark: SparkSession, d: str) -> DataFrame:
    """Fresh pages for the books that have none recognised yet, as many as they have."""
    counts = _pages(spark, d).groupBy(F.col("book_id").alias("id")).agg(F.max("page_index").alias("pages"))
    return L.skeleton(counts.join(books(spark, d).filter("bind is null").select("id"), "id", "left_semi"))


def page_patch(spark: SparkSession, d: str) -> DataFrame:
    """Pages after the recognition of every third unfinished page, and of one page that isn't there."""
    p = _pages(spark, d)
    new = p.filter("not finished or page_index % 3 = 0").select("book_id", "page_index", F.lit(1).alias("version"))
    new = new.unionByName(new.withColumns({"page_index": F.col("page_index") + 100000, "version": F.lit(2)}))
    return L.patch_pages(p, new)


def apply_external(spark: SparkSession, d: str) -> DataFrame:
    """Translations when every page with an even number also answers for the first block of the page before."""
    b = blocks(spark, d).select("book_id", "page_index", "block_pos", "block_id", "translation")
    own = b.filter("block_pos % 4 = 1").select("book_id", "page_index", "block_pos", F.concat(F.lit("own "), "page_index").alias("text"), F.col("page_index").alias("by_page"))
    even = b.filter("page_index % 2 = 0").select("book_id", "page_index").distinct()
    near = even.select("book_id", (F.col("page_index") - 1).alias("page_index"), F.lit(1).alias("block_pos"), F.concat(F.lit("for "), "page_index").alias("text"), F.col("page_index").alias("by_page"))
    return L.apply_external(b, own, near).select("block_id", "translation")


def folder_groups(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d)
    extra = spark.createDataFrame([("unused",)], "folder string")
    return L.by_folder(b, extra)


def folder_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.repeat("p_name", F.lit(9))).when(F.col("p_partkey") % 5 == 1, F.concat("p_name", F.lit("/x"))).when(F.col("p_partkey") % 5 == 2, F.lit("  ")).otherwise(F.col("p_name")).alias("name"))
    return p.select("p_partkey", L.folder_error(F.col("name")).alias("error"))


def folder_cascade(spark: SparkSession, d: str) -> DataFrame:
    """What is left when the folder `manuals` goes with its books."""
    b = books(spark, d)
    return b.join(b.filter("belong = 'manuals'").select("id"), "id", "left_anti").select("id", "name")


def folder_move(spark: SparkSession, d: str) -> DataFrame:
    """Books after moving those of `papers` to `archive`, and blank folders to the root."""
    b = books(spark, d)
    return b.select("id", F.when(F.col("belong") == "papers", "archive").when(F.trim("belong") == "", None).otherwise(F.col("belong")).alias("belong"))


def import_dedup(spark: SparkSession, d: str) -> DataFrame:
    """An import of a file for every listed book, books that are listed twice coming as two files of one content."""
    b = table(spark, d, "books")
    files = b.select(F.concat("id", F.lit("/"), "name", F.when(F.ascii("id") % 7 == 0, F.lit(".txt")).otherwise(F.lit(".PDF"))).alias("path"), F.when(F.ascii("id") % 11 == 0, F.lit(" ")).otherwise(F.col("name")).alias("name"), F.encode("id", "utf-8").alias("content"))
    return L.import_books(files.dropDuplicates(["path"]), b.limit(0).select("id")).groupBy("outcome").agg(F.count("*").alias("files"))


def path_checks(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d)
    n = F.ascii("id") % 4
    path = F.when(n == 0, F.col("bind")).when(n == 1, F.concat(F.lit("/"), "id")).when(n == 2, F.concat(F.lit("a/../"), "id")).otherwise(F.concat(F.lit("C:\\"), "id"))
    return b.select("id", L.relative_path_error(path).alias("error"))


def ring_pick(spark: SparkSession, d: str) -> DataFrame:
    """Of each book the next four pages without recognition from page 3 on."""
    p = _pages(spark, d).filter("not finished")
    return J.ring(p, F.lit(3), 4).select("book_id", "page_index", F.col("place").cast("bigint").alias("place"))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.struct("ts", "event_id").alias("seq"), "event_id", "ts", F.col("user_id").alias("book_id"), F.when(F.col("event_id") % 2 == 0, "ocr").otherwise("translate").alias("kind"), (F.col("event_type") != "error").alias("ok"))


def strikes_running(spark: SparkSession, d: str) -> DataFrame:
    return J.strikes(_jobs(spark, d)).select("event_id", F.col("strikes").cast("bigint").alias("strikes"))


def work_pick(spark: SparkSession, d: str) -> DataFrame:
    """The jobs that may run, with books whose jobs fail most struck out: here those whose id starts with `a`."""
    p = _pages(spark, d)
    work = p.groupBy("book_id").agg(F.bool_or(F.col("finished") & ~F.coalesce("translated", F.lit(False))).alias("needs_translation"), F.bool_or(~F.col("finished")).alias("needs_ocr"))
    place = books(spark, d).select(F.col("id").alias("book_id"), F.unix_micros("added_at").alias("place"))
    struck = work.filter("book_id like 'a%'").select("book_id", F.lit("translate").alias("kind"))
    return J.pick(work.join(place, "book_id"), struck, F.col("book_id") == FOCUS)


def rate_limit_waits(spark: SparkSession, d: str) -> DataFrame:
    e = _jobs(spark, d).withColumn("limited", (F.col("event_id") % 10 == 0)).withColumn("ts", F.col("ts").cast("timestamp"))
    return J.cooldown(e, 600).select("event_id", "waits")


def log_ring(spark: SparkSession, d: str) -> DataFrame:
    """The log's ring: the last 200 lines of each stream."""
    return J.last_lines(_jobs(spark, d), 200, "kind").select("event_id", "kind")


def batch_clamp(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_info")
    asked = F.when(F.col("page_index") % 6 == 0, None).otherwise(F.col("page_index") - 3)
    return p.select("book_id", "page_index", batch_pages(asked).alias("batch"))


def translation_counts(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    return b.groupBy("book_id", "page_index").agg(F.count_if(F.col("translation").isNull()).alias("open"), F.count("translation").alias("translated"), F.count("*").alias("blocks"))


def _models(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a catalog's models: brands are providers, a type is a protocol."""
    p = table(spark, d, "part")
    api = F.element_at(F.array(*map(F.lit, [*C.PROTOCOLS, "other"])), (F.col("p_size") % 4 + 1).cast("int"))
    url = F.concat(F.lit("https://api."), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".example/v"), F.col("p_size") % 3, F.lit("/"))
    return p.select(F.col("p_brand").alias("provider"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("id"), api.alias("api"), url.alias("url"), F.col("p_partkey").alias("place"))


def catalog_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.providers(_models(spark, d))


def provider_detect(spark: SparkSession, d: str) -> DataFrame:
    m = _models(spark, d)
    defaults = m.groupBy("provider").agg(F.min("place").alias("place")).select("provider", "place", F.concat(F.lit("https://api."), F.lower(F.replace("provider", F.lit("#"), F.lit(""))), F.lit(".example")).alias("url"))
    n = F.col("s_suppkey") % 4
    brand = F.concat(F.lit("brand"), F.col("s_suppkey") % 5 + 1, F.col("s_suppkey") % 5 + 1)
    url = F.when(n == 0, F.concat(F.lit(" HTTPS://api."), brand, F.lit(".example/v1/ "))).when(n == 1, F.concat(F.lit("https://api."), brand, F.lit(".example/v9/chat"))).when(n == 2, F.concat(F.lit("https://api."), brand)).otherwise(F.lit("http://elsewhere"))
    return C.detect(table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), url.alias("url")), m, defaults)


def provider_order(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "nation").select(F.col("n_name").alias("provider"), F.col("n_name").alias("label"))
    return C.ordered(p, ["JAPAN", "BRAZIL"]).select("provider", F.col("priority").cast("bigint").alias("priority"))


def model_ids(spark: SparkSession, d: str) -> DataFrame:
    return _models(spark, d).select("id").distinct()


def endpoint_urls(spark: SparkSession, d: str) -> DataFrame:
    """Where questions go and where models are listed; some URLs were pasted with more than the base."""
    pasted = F.element_at(F.array(*map(F.lit, ["", "v1", "v1/messages", "/ ", "messages/"])), (F.col("seq") % 5 + 1).cast("int"))
    m = _models(spark, d).withColumn("url", F.concat(F.lit(" "), F.regexp_replace("url", "/v[0-9]/$", "/"), pasted))
    return m.select("seq", C.endpoint(F.col("url"), F.col("api")).alias("endpoint"), C.models_endpoint(F.col("url"), F.col("api")).alias("models"))


def bound_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The library written as bound documents and read again, by book: pages, finished ones, blocks, characters, grid rows."""
    b = blocks(spark, d).select("book_id", "page_index", "block_pos", "type", "content", "loc", "translation", "grid")
    path = f"{shared_folder(spark)}/bound-{uuid.uuid4().hex}"
    B.write_pages(B.page_documents(_pages(spark, d).withColumn("status", F.lit("Processing")), b), path)
    pages, again = B.read_pages(spark, path)
    sums = again.groupBy("book_id").agg(F.count("*").alias("blocks"), F.sum(F.length("content")).alias("chars"), F.sum(F.length("translation")).alias("translated_chars"), F.sum(F.size("grid.rows")).alias("grid_rows"))
    return pages.groupBy("book_id").agg(F.count("*").alias("pages"), F.count_if("finished").alias("finished"), F.count_if("translated").alias("translated")).join(sums, "book_id", "left")


def _updates(spark: SparkSession, d: str) -> DataFrame:
    """A batch: every third page is recognised again, with two blocks, some twice, the later with one; and a page that isn't there."""
    block = lambda x: F.struct(F.lit(x).alias("content"))
    p = _pages(spark, d).filter("page_index % 3 = 0").select("book_id", "page_index")
    first = p.select("*", F.lit(1).alias("version"), F.array(block("a"), block("bb")).alias("blocks"))
    return first.unionByName(p.filter("page_index % 2 = 0").select("*", F.lit(2).alias("version"), F.array(block("ccc")).alias("blocks"))).unionByName(first.withColumn("page_index", -F.col("page_index")))


def batch_persist(spark: SparkSession, d: str) -> DataFrame:
    """Pages after the batch, with their flags, blocks and characters."""
    b = blocks(spark, d).select("book_id", "page_index", "block_pos", "content")
    pages, after, touched = L.persist_batch(_pages(spark, d), b, _updates(spark, d))
    sums = after.groupBy("book_id", "page_index").agg(F.count("*").alias("blocks"), F.sum(F.length("content")).alias("chars"))
    out = pages.join(sums, ["book_id", "page_index"], "left").fillna(0, ["blocks", "chars"])
    return out.join(touched.withColumn("t", F.lit(True)), ["book_id", "page_index"], "left").select("book_id", "page_index", "finished", "translated", F.coalesce("t", F.lit(False)).alias("touched"), "blocks", "chars")


def book_prefill(spark: SparkSession, d: str) -> DataFrame:
    """Pages by book once the books without any got three each."""
    b = books(spark, d)
    return L.prefill(b, _pages(spark, d), b.select("id", F.lit(3).alias("pages"))).groupBy("book_id").agg(F.count("*").alias("pages"), F.count_if("finished").alias("finished"))


def book_reset(spark: SparkSession, d: str) -> DataFrame:
    """By book, pages and blocks after the books whose id starts with a digit were reset, some to five pages."""
    p, b = _pages(spark, d), blocks(spark, d).select("book_id", "page_index", "block_pos")
    which = p.select("book_id").distinct().filter("book_id rlike '^[0-9]'").select("book_id", F.when(F.col("book_id").rlike("^[0-4]"), 5).otherwise(0).alias("pages"))
    pages, left, status = L.reset(p, b, which)
    n = left.groupBy("book_id").agg(F.count("*").alias("blocks"))
    out = pages.groupBy("book_id").agg(F.count("*").alias("pages"), F.count_if("finished").alias("finished")).join(n, "book_id", "left").fillna(0, ["blocks"])
    return out.join(status, "book_id", "left").select("book_id", "pages", "finished", "blocks", F.coalesce("status", F.lit("as it was")).alias("status"))


QUERIES = {
    f.__name__: f
    for f in (
        bound_roundtrip, batch_persist, book_prefill, book_reset, book_lookup, book_open, book_progress, book_status, book_skeleton, page_patch, apply_external, folder_groups, folder_names, folder_cascade, folder_move, import_dedup, path_checks, ring_pick, strikes_running,
        work_pick, rate_limit_waits, log_ring, batch_clamp, translation_counts, catalog_stats, provider_detect, provider_order, model_ids, endpoint_urls,
    )
}

_BK = "bk AS (SELECT id, b.name AS name, b.bind AS bind, b.belong AS belong, b.status AS status, b.added_at AS added_at FROM (SELECT id, arg_min({'name': name, 'bind': bind, 'belong': belong, 'status': status, 'added_at': added_at}, name || coalesce(bind, '') || coalesce(belong, '')) AS b FROM books GROUP BY id))"
_JOBS = "jb AS (SELECT event_id, ts, user_id AS book_id, CASE WHEN event_id % 2 = 0 THEN 'ocr' ELSE 'translate' END AS kind, event_type <> 'error' AS ok FROM events)"
_MODELS = f"md AS (SELECT p_brand AS provider, p_partkey AS seq, p_name AS id, [{', '.join(repr(x) for x in C.PROTOCOLS)}, 'other'][CAST(p_size % 4 + 1 AS INTEGER)] AS api, 'https://api.' || lower(replace(p_brand, '#', '')) || '.example/v' || (p_size % 3) || '/' AS url FROM part)"
_FIN = "count(*) FILTER (finished)"
SQL = {
    "bound_roundtrip": f"""WITH {BLOCKS}, s AS (SELECT book_id, count(*) AS blocks, sum(length(content)) AS chars, sum(length(translation)) AS translated_chars, sum(len(grid.rows)) AS grid_rows FROM bl GROUP BY 1)
SELECT p.*, CAST(blocks AS BIGINT) AS blocks, CAST(chars AS BIGINT) AS chars, CAST(translated_chars AS BIGINT) AS translated_chars, CAST(grid_rows AS BIGINT) AS grid_rows FROM (SELECT book_id, count(*) AS pages, {_FIN} AS finished, count(*) FILTER (translated) AS translated FROM page_info GROUP BY 1) p LEFT JOIN s USING (book_id)""",
    "batch_persist": f"""WITH {BLOCKS}, s AS (SELECT book_id, page_index, count(*) AS n, sum(length(content)) AS c FROM bl GROUP BY 1, 2)
SELECT book_id, page_index, finished OR page_index % 3 = 0 AS finished, CASE WHEN page_index % 3 = 0 THEN false ELSE coalesce(translated, false) END AS translated, page_index % 3 = 0 AS touched,
 CAST(CASE WHEN page_index % 6 = 0 THEN 1 WHEN page_index % 3 = 0 THEN 2 ELSE coalesce(n, 0) END AS BIGINT) AS blocks, CAST(CASE WHEN page_index % 3 = 0 THEN 3 ELSE coalesce(c, 0) END AS BIGINT) AS chars FROM page_info LEFT JOIN s USING (book_id, page_index)""",
    "book_prefill": f"SELECT book_id, count(*) AS pages, {_FIN} AS finished FROM page_info GROUP BY 1 UNION ALL SELECT DISTINCT id, 3, 0 FROM books WHERE id NOT IN (SELECT book_id FROM page_info)",
    "book_reset": f"""WITH {BLOCKS}, s AS (SELECT book_id, count(*) AS n FROM bl GROUP BY 1)
SELECT book_id, CASE WHEN regexp_matches(book_id, '^[0-4]') THEN 5 ELSE count(*) END AS pages, CASE WHEN regexp_matches(book_id, '^[0-9]') THEN 0 ELSE {_FIN} END AS finished, CASE WHEN regexp_matches(book_id, '^[0-9]') THEN 0 ELSE coalesce(any_value(n), 0) END AS blocks,
 CASE WHEN regexp_matches(book_id, '^[0-9]') THEN 'Pending' ELSE 'as it was' END AS status FROM page_info LEFT JOIN s USING (book_id) GROUP BY 1""",
    "book_lookup": f"WITH {_BK} SELECT id, name FROM bk WHERE id = '{FOCUS}'",
    "book_open": f"WITH {_BK}, s AS (SELECT book_id AS id, count(*) AS pages, {_FIN} AS finished FROM page_info GROUP BY 1) SELECT id, name, CASE WHEN bind IS NOT NULL THEN status ELSE 'Pending' END AS status, CASE WHEN bind IS NOT NULL THEN coalesce(pages, 0) ELSE 0 END AS pages, CASE WHEN bind IS NOT NULL THEN coalesce(finished, 0) ELSE 0 END AS finished FROM bk LEFT JOIN s USING (id)",
    "book_progress": f"SELECT book_id, {_FIN} AS finished, count(*) FILTER (translated) AS translated, count(*) AS pages FROM page_info GROUP BY 1",
    "book_status": f"WITH {_BK}, s AS (SELECT book_id AS id, count(*) AS n, bool_and(finished) AS d FROM page_info GROUP BY 1) SELECT id, status, CASE WHEN n > 0 AND d THEN 'Finished' WHEN status = 'Pending' THEN 'Processing' ELSE status END AS next_status FROM bk LEFT JOIN s USING (id)",
    "book_skeleton": f"WITH {_BK}, c AS (SELECT book_id AS id, max(page_index) AS n FROM page_info GROUP BY 1) SELECT id, CAST(i AS INTEGER) AS page_index, false AS finished, false AS translated FROM c, unnest(range(1, n + 1)) AS u(i) WHERE id IN (SELECT id FROM bk WHERE bind IS NULL)",
    "page_patch": "SELECT book_id, page_index, finished OR page_index % 3 = 0 OR NOT finished AS finished, CASE WHEN NOT finished OR page_index % 3 = 0 THEN false ELSE coalesce(translated, false) END AS translated, NOT finished OR page_index % 3 = 0 AS touched FROM page_info",
    "apply_external": f"WITH {BLOCKS}, e AS (SELECT DISTINCT book_id, page_index FROM bl WHERE page_index % 2 = 0) SELECT block_id, CASE WHEN block_pos = 1 AND e.page_index IS NOT NULL THEN 'for ' || e.page_index WHEN block_pos % 4 = 1 THEN 'own ' || bl.page_index ELSE translation END AS translation FROM bl LEFT JOIN e ON e.book_id = bl.book_id AND e.page_index = bl.page_index + 1",
    "folder_groups": f"WITH {_BK}, o AS (SELECT coalesce(trim(belong), '') AS folder, count(*) AS books, min(name) AS first FROM bk GROUP BY 1), f AS (SELECT folder FROM o UNION SELECT 'unused') SELECT folder, coalesce(books, 0) AS books, first FROM f LEFT JOIN o USING (folder)",
    "folder_names": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN length(p_name) * 9 > 64 THEN 'too long' END WHEN 1 THEN 'separator' WHEN 2 THEN 'empty' END AS error FROM part",
    "folder_cascade": f"WITH {_BK} SELECT id, name FROM bk WHERE belong IS DISTINCT FROM 'manuals'",
    "folder_move": f"WITH {_BK} SELECT id, CASE WHEN belong = 'papers' THEN 'archive' WHEN trim(belong) = '' THEN NULL ELSE belong END AS belong FROM bk",
    "import_dedup": "WITH f AS (SELECT DISTINCT id, name FROM books), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY id || '/' || name || CASE WHEN ascii(id) % 7 = 0 THEN '.txt' ELSE '.PDF' END) AS c FROM f) SELECT CASE WHEN ascii(id) % 7 = 0 THEN 'not a pdf' WHEN ascii(id) % 11 = 0 THEN 'no name' WHEN c > 1 THEN 'already there' ELSE 'imported' END AS outcome, count(*) AS files FROM k GROUP BY 1",
    "path_checks": f"WITH {_BK} SELECT id, CASE ascii(id) % 4 WHEN 0 THEN CASE WHEN bind IS NULL THEN 'empty' END WHEN 1 THEN 'absolute' WHEN 2 THEN 'leaves the folder' ELSE 'absolute' END AS error FROM bk",
    "ring_pick": "WITH p AS (SELECT book_id, page_index, max(page_index) OVER (PARTITION BY book_id) AS total FROM page_info WHERE NOT finished), q AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ((page_index - 3) % total + total) % total) AS place FROM p) SELECT book_id, page_index, place FROM q WHERE place <= 4",
    "strikes_running": f"WITH {_JOBS}, i AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, kind ORDER BY ts, event_id) AS island FROM jb) SELECT event_id, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY book_id, kind, island ORDER BY ts, event_id) AS BIGINT) AS strikes FROM i",
    "work_pick": f"WITH {_BK}, w AS (SELECT book_id, bool_or(finished AND NOT coalesce(translated, false)) AS t, bool_or(NOT finished) AS o FROM page_info GROUP BY 1), k AS (SELECT book_id, CASE WHEN t AND book_id NOT LIKE 'a%' THEN 'translate' WHEN o THEN 'ocr' END AS kind, book_id = '{FOCUS}' AS focused, epoch_us(added_at) AS place FROM w JOIN bk ON bk.id = w.book_id) SELECT * FROM k WHERE kind IS NOT NULL",
    "rate_limit_waits": "WITH k AS (SELECT event_id, ts, max(CASE WHEN event_id % 10 = 0 THEN ts END) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM events) SELECT event_id, coalesce(epoch_us(ts) < epoch_us(l) + 600000000, false) AS waits FROM k",
    "log_ring": f"WITH {_JOBS} SELECT event_id, kind FROM jb QUALIFY row_number() OVER (PARTITION BY kind ORDER BY ts DESC, event_id DESC) <= 200",
    "batch_clamp": "SELECT book_id, page_index, CAST(least(greatest(coalesce(CASE WHEN page_index % 6 = 0 THEN NULL ELSE page_index - 3 END, 4), 1), 32) AS INTEGER) AS batch FROM page_info",
    "translation_counts": f"WITH {BLOCKS} SELECT book_id, page_index, count(*) FILTER (translation IS NULL) AS open, count(translation) AS translated, count(*) AS blocks FROM bl GROUP BY 1, 2",
    "catalog_stats": f"WITH {_MODELS}, u AS (SELECT provider, url, count(*) AS n, min(seq) AS f FROM md GROUP BY 1, 2), t AS (SELECT provider, url FROM u QUALIFY row_number() OVER (PARTITION BY provider ORDER BY n DESC, f) = 1) SELECT provider, count(DISTINCT id) AS models, count(*) FILTER (api <> 'other') AS usable, any_value(t.url) AS url FROM md JOIN t USING (provider) GROUP BY 1",
    "provider_detect": f"""WITH {_MODELS}, e AS (SELECT rtrim(url, '/') AS u, arg_min(provider, seq) AS provider FROM md GROUP BY 1), b AS (SELECT provider, min(seq) AS place, 'https://api.' || lower(replace(provider, '#', '')) || '.example' AS base FROM md GROUP BY 1),
s AS (SELECT s_suppkey AS key, 'brand' || (s_suppkey % 5 + 1) || (s_suppkey % 5 + 1) AS br, s_suppkey % 4 AS n FROM supplier),
q AS (SELECT key, CASE n WHEN 0 THEN 'https://api.' || br || '.example/v1' WHEN 1 THEN 'https://api.' || br || '.example/v9/chat' WHEN 2 THEN 'https://api.' || br ELSE 'http://elsewhere' END AS u FROM s)
SELECT key, coalesce(e.provider, (SELECT arg_min(b.provider, b.place) FROM b WHERE regexp_extract(b.base, '^[a-z]*:?/*([^/:]*)', 1) = regexp_extract(q.u, '^[a-z]*:?/*([^/:]*)', 1) AND (starts_with(q.u, b.base) OR starts_with(b.base, q.u))), 'custom') AS provider FROM q LEFT JOIN e USING (u)""",
    "provider_order": "SELECT n_name AS provider, CAST(CASE n_name WHEN 'JAPAN' THEN 1 WHEN 'BRAZIL' THEN 2 ELSE 3 END AS BIGINT) AS priority FROM nation",
    "model_ids": "SELECT DISTINCT p_name AS id FROM part",
    "endpoint_urls": f"""WITH {_MODELS}, u AS (SELECT seq, api, 'https://api.' || lower(replace(provider, '#', '')) || '.example' AS h, seq % 5 AS k FROM md),
r AS (SELECT seq, api, h, CASE k WHEN 1 THEN h || '/v1' WHEN 2 THEN h || '/v1/messages' WHEN 4 THEN h || '/messages' ELSE h END AS root FROM u)
SELECT seq, CASE api WHEN 'anthropic-messages' THEN h || '/v1/messages' WHEN 'openai-responses' THEN root || '/responses' ELSE root || '/chat/completions' END AS endpoint,
 CASE api WHEN 'anthropic-messages' THEN h || '/v1/models' ELSE root || '/models' END AS models FROM r""",
}

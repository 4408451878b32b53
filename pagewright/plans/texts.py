"""Queries on block and document text, types, and small formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import geom as G
from pagewright.functions import text as T
from pagewright.operators import folds
from pagewright.session import table

from .views import BLOCKS, SERVICE, blocks, service_pages


def _blocks(*columns):
    def q(spark: SparkSession, d: str) -> DataFrame:
        return blocks(spark, d).select("block_id", *(make().alias(name) for name, make in columns))

    return q


def _documents(*columns):
    def q(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "documents").select("doc_id", *(make().alias(name) for name, make in columns))

    return q


FEATURES = ["norm", "norm_len", "toks", "tok_len", "grams", "heads"]
C, X = (lambda: F.col("content")), (lambda: F.col("text"))


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Blocks and the next block of their page: features of both readings."""
    b = blocks(spark, d).filter("content <> ''").select("block_id", "book_id", "page_index", "block_pos", *T.features(F.col("content")))
    names = ["block_id", *FEATURES]
    left = b.select("book_id", "page_index", (F.col("block_pos") + 1).alias("block_pos"), *(F.col(c).alias(f"a_{c}") for c in names))
    return left.join(b.select("book_id", "page_index", "block_pos", *(F.col(c).alias(f"b_{c}") for c in names)), ["book_id", "page_index", "block_pos"])


def _sides() -> tuple[dict, dict]:
    return tuple({c: F.col(f"{s}_{c}") for c in FEATURES} for s in "ab")


def text_fuzzy_pairs(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides()
    return neighbours(spark, d).select("a_block_id", "b_block_id", T.fuzzy_hits(a["toks"], b["toks"], b["heads"]).alias("hits"))


def text_dual_foreign(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides()
    return neighbours(spark, d).filter(T.looks_dual(a, b)).select("a_block_id", "b_block_id")


def text_dice_titles(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of each page's header to the book's name."""
    b = blocks(spark, d).filter("type = 'header'").select("block_id", "book_id", T.normalized(F.col("content")).alias("a"))
    names = table(spark, d, "books").groupBy(F.col("id").alias("book_id")).agg(F.min("name").alias("name")).select("book_id", T.normalized(F.col("name")).alias("b"))
    return b.join(names, "book_id").select("block_id", T.dice(F.col("a"), F.col("b")).alias("dice"))


def _nested(spark: SparkSession, d: str) -> DataFrame:
    s = service_pages(spark, d).select("service_page_id", F.posexplode("blocks").alias("pos", "b"))
    return s.select("service_page_id", "pos", F.col("b.type").alias("type"), F.col("b.label").alias("label"), F.col("b.content").alias("content"))


def text_clean(spark: SparkSession, d: str) -> DataFrame:
    n = _nested(spark, d)
    return n.select("service_page_id", "pos", T.clean_content(T.resolve_type(F.col("type"), F.col("label")), F.col("content")).alias("content"))


def text_formula_wrap(spark: SparkSession, d: str) -> DataFrame:
    n = _nested(spark, d).filter("type = 'equation'")
    bare = T.trim(F.regexp_replace("content", r"\$\$", ""))
    return n.select("service_page_id", "pos", T.wrap_formula(bare).alias("wrapped"), T.wrap_formula(F.col("content")).alias("kept"))


def label_map_foreign(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark, d).groupBy("type", T.map_type(F.col("type")).alias("client_type")).agg(F.count("*").alias("blocks"))


def label_resolve(spark: SparkSession, d: str) -> DataFrame:
    n = _nested(spark, d)
    return n.select("service_page_id", "pos", T.resolve_type(F.col("type"), F.col("label")).alias("client_type"))


def display_text(spark: SparkSession, d: str) -> DataFrame:
    """What a cover shows: the translation or else the content, of blocks other than tables that have any."""
    shown = F.coalesce("translation", "content")
    return blocks(spark, d).filter(~T.is_blank(shown) & (F.col("type") != "table")).select("block_id", shown.alias("shown"))


def math_segments(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d).select("block_id", F.posexplode(T.math_segments(F.col("content"))).alias("n", "formula"))
    return b.select("block_id", "n", "formula", T.escape_html(F.col("formula")).alias("escaped"))


def types_per_page(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).groupBy("book_id", "page_index").agg(F.countDistinct("type").alias("types"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("type_list"))


def dedup_foreign_fold(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate readings of a page: survivors, their grown boxes and the readings they stand for."""
    b = blocks(spark, d).filter((F.size("loc") == 4) & F.col("type").isin(T.TEXT_FAMILY) & T.has_words(F.col("content")))
    at = {c: F.col("loc")[i] for i, c in enumerate(("x1", "y1", "x2", "y2"))}
    item = b.select("book_id", "page_index", "block_id", "block_pos", *(v.alias(k) for k, v in at.items()), *T.features(F.col("content")))
    visit = F.struct((-F.col("norm_len")).alias("o1"), (-G.area(G.box())).alias("o2"), F.col("block_pos").alias("o3"), "block_id", "x1", "y1", "x2", "y2", *FEATURES)
    pages = item.groupBy("book_id", "page_index").agg(F.collect_list(visit).alias("items"))
    kept = pages.select(F.explode(folds.dedup_text(F.col("items"), T.looks_dual)).alias("k"))
    return kept.select("k.item.block_id", "k.x1", "k.y1", "k.x2", "k.y2", "k.size")


def dedup_loss_audit(spark: SparkSession, d: str) -> DataFrame:
    """Characters of text before and after the merge, by book; more than 5 % lost is flagged."""
    b = blocks(spark, d).filter(F.col("type").isin(T.TEXT_FAMILY)).select("block_id", "book_id", F.length(F.regexp_replace("content", r"\s", "")).alias("n"), F.size("loc").alias("s"))
    kept = dedup_foreign_fold(spark, d).select("block_id", F.lit(True).alias("kept"))
    j = b.filter("s = 4").join(kept, "block_id", "left")
    out = j.groupBy("book_id").agg(F.sum("n").alias("before"), F.sum(F.when(F.col("kept"), F.col("n")).otherwise(0)).alias("after"))
    return out.withColumn("lossy", F.col("after") < F.col("before") * 0.95)


def page_filter_parse(spark: SparkSession, d: str) -> DataFrame:
    """Page filters ("0,2-4") made of each service page, parsed: the pages, or the reason why not."""
    from pagewright.sources.requests import parse_page_filter

    s = service_pages(spark, d)
    i = F.col("service_index")
    raw = F.when(i % 5 == 0, F.lit(None)).when(i % 5 == 1, F.concat(i, F.lit(",0-2, "), i)).when(i % 5 == 2, F.concat(i, F.lit("-"), i + 2)).when(i % 5 == 3, F.concat(F.lit("-"), i)).otherwise(F.lit(" , "))
    total = i + 2
    p = s.select("service_page_id", parse_page_filter(raw, total).alias("p"))
    return p.select("service_page_id", "p.error", F.array_join("p.pages", ",").alias("pages"))


def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "books").select("id").distinct()
    n = F.ascii(F.substring("id", 2, 1)) % 5
    url = F.when(n == 0, F.concat(F.lit(" "), "id", F.lit(".example/api//"))).when(n == 1, F.concat(F.lit("https://user@"), "id", F.lit(":9055/x?y"))).when(n == 2, F.lit("http://127.0.0.1:80/")).when(n == 3, F.concat(F.lit("file:///"), "id")).otherwise(F.lit("[::1]:9055"))
    u = b.select("id", T.normalize_url(url).alias("url"))
    return u.select("id", "url", T.is_loopback(F.col("url")).alias("loopback"))


def version_gt(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("v"), F.col("p_size") % 4, F.lit("."), F.col("p_partkey") % 7, F.lit("-beta")).alias("a"), F.concat(F.col("p_size") % 3, F.lit("."), F.col("p_partkey") % 5, F.lit("."), F.col("p_size") % 2).alias("b"))
    return p.select("p_partkey", T.version_gt(F.col("a"), F.col("b")).alias("newer"))


def retry_plan(spark: SparkSession, d: str) -> DataFrame:
    s = service_pages(spark, d)
    status = F.element_at(F.array(*map(F.lit, [200, 429, 500, 503, 404, 504, 502])), (F.col("service_page_id") % 7 + 1).cast("int"))
    wish = F.when(F.col("service_page_id") % 3 == 0, (F.col("service_index") * 4).cast("double"))
    attempt = (F.col("service_page_id") % 4).cast("double")
    return s.select("service_page_id", T.retry_class(status).alias("retry"), T.retry_step(status, attempt, wish).alias("step"), T.backoff_seconds(attempt, wish).alias("wait_s"))


def error_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of error bodies in several shapes, made of service pages."""
    s, m = service_pages(spark, d), F.col("service_page_id") % 7
    name = F.col("service_page_id").cast("string")
    shapes = ['{"detail":"d%","message":"m%"}', '{"object":"error","message":"m%","error":{"message":"e%"}}', '{"error":{"message":"e%"}}', '{"detail":[{"msg":"no"}],"message":"m%"}', '{"detail":7,"error":"x%"}', "<html>gateway %</html>", '{"message":null,"error":{"message":"e%"}}']
    body = F.replace(F.element_at(F.array(*map(F.lit, shapes)), (m + 1).cast("int")), F.lit("%"), name)
    return s.select("service_page_id", T.error_message(body).alias("message"))


def data_uri_decode(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "books").select("id", "name").groupBy("id").agg(F.min("name").alias("name"))
    payload = F.concat(F.when(F.ascii("id") % 2 == 0, F.lit("data:image/png;base64,")).otherwise(F.lit("")), F.base64(F.encode("name", "utf-8")))
    back = T.decode_data_uri(payload)
    return b.select("id", F.decode(back, "utf-8").alias("name"), F.octet_length(back).alias("bytes"))


QUERIES = {
    "text_normalize": _blocks(("norm", lambda: T.normalized(C()))),
    "text_tokens": _documents(("tokens", lambda: F.array_join(T.tokens(X(), "foreign"), " ")), ("distinct_tokens", lambda: F.size(T.tokens(X())))),
    "text_has_words": _blocks(("words", lambda: T.has_words(C())), ("placeholder", lambda: T.is_placeholder(C()))),
    "text_body_like": _documents(("body", lambda: T.looks_like_body(X()))),
    "text_translatable": _blocks(("translatable", lambda: T.is_translatable(F.col("type"), C()))),
    "text_truncate": _documents(("head", lambda: F.left(X(), F.lit(300)))),
} | {
    f.__name__: f
    for f in (
        text_fuzzy_pairs, text_dual_foreign, text_dice_titles, text_clean, text_formula_wrap, label_map_foreign, label_resolve, display_text, math_segments, types_per_page, dedup_foreign_fold,
        dedup_loss_audit, page_filter_parse, url_normalize, version_gt, retry_plan, error_messages, data_uri_decode,
    )
}



def _trim(x: str) -> str:
    return r"regexp_replace(regexp_replace(" + x + r", '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '')"


def _norm(x: str) -> str:
    return r"lower(regexp_replace(" + x + r", '[^\p{L}\p{N}]', '', 'g'))"


def _label(x: str) -> str:
    return "regexp_replace(lower(" + _trim(x) + "), '[ -]', '_', 'g')"


def _map(x: str) -> str:
    names = ", ".join(f"'{a}': '{b}'" for a, b in ({k: k for k in T.CLIENT_TYPES} | T.SYNONYMS).items())
    return "coalesce(MAP {" + names + "}[" + _label(x) + "], 'text')"


def _wrap(x: str) -> str:
    marks = " OR ".join(f"contains({x}, '{m}')" for m in ("$", "\\(", "\\)", "\\[", "\\]"))
    return f"CASE WHEN regexp_matches({x}, '[\\\\^_{{}}=]') AND NOT ({marks}) THEN '$$' || {x} || '$$' ELSE {x} END"


def _hits(a: str, b: str) -> str:
    return f"len(list_filter({a}, lambda t: list_contains({b}, t) OR (length(t) >= 4 AND list_contains(list_transform(list_filter({b}, lambda o: length(o) >= 4), lambda o: left(o, 4)), left(t, 4)))))"


def _grams(x: str) -> str:
    return f"CASE WHEN length({x}) >= 2 THEN list_transform(range(1, length({x})), lambda i: substring({x}, i, 2)) ELSE [] END"


def _dice(ga: str, gb: str, a: str, b: str) -> str:
    shared = f"list_sum(list_transform(list_intersect(list_distinct({ga}), {gb}), lambda x: least(len(list_filter({ga}, lambda y: y = x)), len(list_filter({gb}, lambda y: y = x)))))"
    return f"CASE WHEN len({ga}) + len({gb}) = 0 THEN CASE WHEN {a} = {b} THEN 1.0 ELSE 0.0 END ELSE coalesce({shared}, 0) * 2.0 / (len({ga}) + len({gb})) END"


_TYPES = ", ".join(f"'{x}'" for x in T.CLIENT_TYPES)
_RESOLVE = f"CASE WHEN label IN ({_TYPES}) THEN label WHEN {_map('type')} <> 'text' THEN {_map('type')} ELSE {_map('label')} END"
_NESTED = SERVICE + ", n AS (SELECT service_page_id, CAST(i - 1 AS INTEGER) AS pos, blocks[i].type AS type, blocks[i].label AS label, blocks[i].content AS content FROM sp, unnest(range(1, len(blocks) + 1)) AS u(i))"
_TRANS = ", ".join(f"'{x}'" for x in T.TRANSLATABLE)
_FEATURES = f"""f AS (SELECT block_id, book_id, page_index, block_pos, {_norm('content')} AS norm, regexp_extract_all(lower(content), '[0-9a-z]+') AS toks FROM bl WHERE content <> ''),
g AS (SELECT *, length(norm) AS norm_len, coalesce(list_sum(list_transform(toks, lambda t: length(t))), 0) AS tok_len FROM f),
p AS (SELECT a.block_id AS a_block_id, b.block_id AS b_block_id, a.norm AS an, b.norm AS bn, a.norm_len AS al, b.norm_len AS bln, a.toks AS at_, b.toks AS bt, a.tok_len AS atl, b.tok_len AS btl FROM g a JOIN g b ON a.book_id = b.book_id AND a.page_index = b.page_index AND b.block_pos = a.block_pos + 1)"""

SQL = {
    "text_normalize": f"WITH {BLOCKS} SELECT block_id, {_norm('content')} AS norm FROM bl",
    "text_tokens": "SELECT doc_id, array_to_string(t, ' ') AS tokens, CAST(len(list_distinct(t)) AS INTEGER) AS distinct_tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z]+') AS t FROM documents)",
    "text_has_words": f"WITH {BLOCKS} SELECT block_id, length(regexp_replace(content, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 2 AS words, {_norm('content')} IN ('unlabeled', 'na', 'notext') AS placeholder FROM bl",
    "text_body_like": r"SELECT doc_id, length(regexp_replace(text, '[\s\p{Z}]', '', 'g')) >= 150 AND len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\s\p{Z}]', '', 'g') <> '')) >= 3 AND length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= length(regexp_replace(text, '[\s\p{Z}]', '', 'g')) * 0.6::DOUBLE AS body FROM documents",
    "text_translatable": f"WITH {BLOCKS} SELECT block_id, type IN ({_TRANS}) AND {_trim('content')} <> '' AS translatable FROM bl",
    "text_truncate": "SELECT doc_id, left(text, 300) AS head FROM documents",
    "text_fuzzy_pairs": f"WITH {BLOCKS}, {_FEATURES} SELECT a_block_id, b_block_id, CAST({_hits('at_', 'bt')} AS INTEGER) AS hits FROM p",
    "text_dice_titles": f"WITH {BLOCKS}, h AS (SELECT block_id, {_norm('content')} AS a, {_norm('name')} AS b FROM bl JOIN (SELECT id AS book_id, min(name) AS name FROM books GROUP BY 1) USING (book_id) WHERE type = 'header'), k AS (SELECT *, {_grams('a')} AS ga, {_grams('b')} AS gb FROM h) SELECT block_id, {_dice('ga', 'gb', 'a', 'b')} AS dice FROM k",
    "text_dual_foreign": f"""WITH {BLOCKS}, {_FEATURES}, q AS (SELECT *, CASE WHEN len(at_) <= len(bt) THEN {_hits('at_', 'bt')} ELSE {_hits('bt', 'at_')} END AS hits, {_grams('an')} AS ga, {_grams('bn')} AS gb FROM p)
SELECT a_block_id, b_block_id FROM q WHERE al > 0 AND bln > 0 AND (an = bn OR (least(al, bln) >= 8 AND (CASE WHEN al <= bln THEN contains(bn, an) ELSE contains(an, bn) END))
 OR (least(len(at_), len(bt)) > 0 AND hits >= least(len(at_), len(bt)) * 0.7::DOUBLE AND least(atl / al, btl / bln) >= 0.6 AND (least(len(at_), len(bt)) >= 3 OR (hits = least(len(at_), len(bt)) AND least(al, bln) >= 8)))
 OR (2.0 * least(len(ga), len(gb)) >= 0.82 * (len(ga) + len(gb)) AND {_dice('ga', 'gb', 'an', 'bn')} >= 0.82))""",
    "text_clean": f"""WITH {_NESTED}, k AS (SELECT service_page_id, pos, {_RESOLVE} AS kind, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS c FROM n),
m AS (SELECT service_page_id, pos, kind, {_trim("regexp_replace(CASE WHEN kind IN ('doc_title', 'paragraph_title', 'figure_title') THEN regexp_replace(regexp_replace(c, '^[\\s\\p{Z}]*#+[\\s\\p{Z}]*', ''), '</?center>', '', 'g') ELSE c END, '\\n{3,}', chr(10) || chr(10), 'g')")} AS c FROM k)
SELECT service_page_id, pos, CASE WHEN kind = 'formula' THEN {_wrap('c')} ELSE c END AS content FROM m""",
    "text_formula_wrap": f"WITH {_NESTED}, k AS (SELECT service_page_id, pos, content, {_trim("replace(content, '$$', '')")} AS bare FROM n WHERE type = 'equation') SELECT service_page_id, pos, {_wrap('bare')} AS wrapped, {_wrap('content')} AS kept FROM k",
    "label_map_foreign": f"WITH {_NESTED} SELECT type, {_map('type')} AS client_type, count(*) AS blocks FROM n GROUP BY 1, 2",
    "label_resolve": f"WITH {_NESTED} SELECT service_page_id, pos, {_RESOLVE} AS client_type FROM n",
    "display_text": f"WITH {BLOCKS} SELECT block_id, coalesce(translation, content) AS shown FROM bl WHERE coalesce({_trim('coalesce(translation, content)')}, '') <> '' AND type <> 'table'",
    "types_per_page": f"WITH {BLOCKS} SELECT book_id, page_index, count(DISTINCT type) AS types, array_to_string(list_sort(list(DISTINCT type)), ',') AS type_list FROM bl GROUP BY 1, 2",
    "math_segments": f"WITH {BLOCKS}, s AS (SELECT block_id, regexp_extract_all(content, '(?s)\\$\\$.+?\\$\\$|\\\\\\[.+?\\\\\\]|\\\\\\(.+?\\\\\\)') AS l FROM bl) SELECT block_id, CAST(i - 1 AS INTEGER) AS n, l[i] AS formula, replace(replace(replace(replace(l[i], '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') AS escaped FROM s, unnest(range(1, len(l) + 1)) AS u(i)",
    "version_gt": "SELECT p_partkey, (p_size % 4, p_partkey % 7, 0) > (p_size % 3, p_partkey % 5, p_size % 2) AS newer FROM part",
    "retry_plan": f"WITH {SERVICE}, r AS (SELECT *, [200, 429, 500, 503, 404, 504, 502][service_page_id % 7 + 1] AS status, CASE WHEN service_page_id % 3 = 0 THEN service_index * 4.0 END AS wish FROM sp) SELECT service_page_id, CASE WHEN status = 429 THEN 'quota' WHEN status IN (500, 502, 503, 504) THEN 'transient' ELSE 'never' END AS retry, CASE WHEN status IN (200, 404) THEN 'fail' WHEN status = 429 AND (service_page_id % 4 >= 2 OR wish > 30) THEN 'park' WHEN service_page_id % 4 >= 2 THEN 'fail' ELSE 'wait' END AS step, greatest(0.1, least(30.0, coalesce(CAST(wish AS DOUBLE), pow(2.0, service_page_id % 4)))) AS wait_s FROM r",
    "error_messages": f"WITH {SERVICE} SELECT service_page_id, CASE service_page_id % 7 WHEN 0 THEN 'd' || service_page_id WHEN 1 THEN 'm' || service_page_id WHEN 2 THEN 'e' || service_page_id WHEN 3 THEN 'm' || service_page_id WHEN 4 THEN '{{\"detail\":7,\"error\":\"x' || service_page_id || '\"}}' WHEN 5 THEN '<html>gateway ' || service_page_id || '</html>' ELSE 'e' || service_page_id END AS message FROM sp",
    "data_uri_decode": "SELECT id, min(name) AS name, CAST(strlen(min(name)) AS INTEGER) AS bytes FROM books GROUP BY 1",
    "url_normalize": "WITH b AS (SELECT DISTINCT id, ascii(substring(id, 2, 1)) % 5 AS n FROM books) SELECT id, CASE n WHEN 0 THEN 'http://' || id || '.example/api' WHEN 1 THEN 'https://user@' || id || ':9055/x?y' WHEN 2 THEN 'http://127.0.0.1:80' WHEN 3 THEN NULL ELSE 'http://[::1]:9055' END AS url, CASE n WHEN 0 THEN false WHEN 1 THEN false WHEN 3 THEN NULL ELSE true END AS loopback FROM b",
    "page_filter_parse": f"""WITH {SERVICE} SELECT service_page_id, CASE service_index % 5 WHEN 2 THEN 'out of range' WHEN 3 THEN 'malformed' WHEN 4 THEN 'no page' END AS error,
 CASE service_index % 5 WHEN 0 THEN array_to_string(range(0, service_index + 2), ',') WHEN 1 THEN array_to_string(list_sort(list_distinct(list_concat([0, 1, 2], [service_index]))), ',') END AS pages FROM sp""",
}

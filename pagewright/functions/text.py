"""Text of blocks as column expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Readings that stand for "nothing here", and the vocabularies of block types.
PLACEHOLDERS = ["[unlabeled]", "[n/a]", "[no text]"]
TEXT_FAMILY = ["text", "paragraph_title", "doc_title", "abstract", "aside_text", "footnote", "footer", "vision_footnote", "figure_title", "content", "reference", "reference_content", "number"]
NATIVE_TEXT_FAMILY = [*TEXT_FAMILY, "header", "formula_number"]
CLIENT_TYPES = [*TEXT_FAMILY, "algorithm", "header", "chart", "seal", "table", "image", "formula"]
TRANSLATABLE = ["text", "paragraph_title", "doc_title", "abstract", "content", "footnote", "figure_title", "aside_text", "reference_content", "table"]
SYNONYMS = {
    "title": "doc_title", "heading": "doc_title", "headline": "doc_title", "document_title": "doc_title", "sub_title": "paragraph_title", "subtitle": "paragraph_title", "section_header": "paragraph_title", "section_title": "paragraph_title",
    "caption": "figure_title", "figure_caption": "figure_title", "image_caption": "figure_title", "table_caption": "figure_title", "equation": "formula", "math": "formula", "formula_number": "formula", "table_body": "table",
    "figure": "image", "picture": "image", "illustration": "image", "diagram": "image", "code": "algorithm", "listing": "algorithm", "references": "reference", "bibliography": "reference", "sidebar": "aside_text",
    "page_header": "header", "running_head": "header", "page_footer": "footer", "endnote": "footnote", "summary": "abstract", "keywords": "abstract", "page_number": "number", "signature": "seal", "stamp": "seal",
}

_SPACE = r"[\s\p{Z}]"


def trim(c: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(F.regexp_replace(c, f"^{_SPACE}+", ""), f"{_SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(trim(c), F.lit("")) == ""


def normalized(c: Column, dialect: str = "native") -> Column:
    """Letters and digits in lower case. The foreign dialect also keeps what Unicode calls alphabetic, as vowel signs."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]" if dialect == "native" else r"[^\p{IsAlphabetic}\p{N}]", ""))


def tokens(c: Column, dialect: str = "native") -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit("[0-9a-z]+"), 0)
    return F.array_distinct(found) if dialect == "native" else found


def has_words(c: Column, least: int = 2) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) >= max(1, least)


def is_placeholder(c: Column) -> Column:
    return normalized(c).isin([p.strip("[]").replace("/", "").replace(" ", "") for p in PLACEHOLDERS])


def looks_like_body(c: Column, least_chars: int = 150, least_lines: int = 3, least_share: float = 0.6) -> Column:
    solid = F.length(F.regexp_replace(c, _SPACE, ""))
    lines = F.size(F.filter(F.split(c, "\n"), lambda x: ~is_blank(x)))
    words = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return (solid >= least_chars) & (lines >= least_lines) & (words >= solid * least_share)


def token_heads(toks: Column, head: int = 4) -> Column:
    return F.array_distinct(F.transform(F.filter(toks, lambda o: F.length(o) >= head), lambda o: F.left(o, F.lit(head))))


def fuzzy_hits(some: Column, others: Column, heads: Column, head: int = 4) -> Column:
    """How many of `some` tokens are among the others, or share the first `head` characters with one (`heads`)."""
    return F.size(F.filter(some, lambda t: F.array_contains(others, t) | ((F.length(t) >= head) & F.array_contains(heads, F.left(t, F.lit(head))))))


def bigrams(c: Column) -> Column:
    """All pairs of neighbouring characters, with repeats."""
    n = F.length(c)
    chars = F.split(c, "")
    pairs = F.zip_with(F.slice(chars, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(chars, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, y: F.concat(x, y))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of character bigrams with repeats; texts without bigrams compare as equal or not."""
    return _dice(bigrams(a), bigrams(b), a == b)


def _dice(ga: Column, gb: Column, equal: Column) -> Column:
    total = F.size(ga) + F.size(gb)
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    shared = F.aggregate(F.array_intersect(ga, gb), F.lit(0), lambda acc, g: acc + F.least(count(ga, g), count(gb, g)))
    return F.when(total == 0, F.when(equal, 1.0).otherwise(0.0)).otherwise(shared * 2.0 / total)


def dice_reaches(a, b, ratio: float) -> Column:
    """Is the Dice coefficient of two readings' `grams` at least `ratio`? Bounds that need no counting decide most pairs."""
    ga, gb = a["grams"], b["grams"]
    total = F.size(ga) + F.size(gb)
    fewer = F.least(F.size(ga), F.size(gb))
    most = F.least(F.size(ga) - F.size(F.array_except(ga, gb)), F.size(gb) - F.size(F.array_except(gb, ga)))
    low = (total > 0) & ((fewer * 2.0 < total * F.lit(ratio)) | (most * 2.0 < total * F.lit(ratio)))
    return F.when(low, False).otherwise(_dice(ga, gb, a["norm"] == b["norm"]) >= ratio)


def features(content: Column, dialect: str = "foreign") -> list[Column]:
    """What `looks_dual` compares, computed once a text: norm, norm_len, toks, tok_len, grams, heads."""
    norm, toks = normalized(content, dialect), tokens(content, dialect)
    return [norm.alias("norm"), F.length(norm).alias("norm_len"), toks.alias("toks"), F.aggregate(toks, F.lit(0), lambda n, t: n + F.length(t)).alias("tok_len"), bigrams(norm).alias("grams"), token_heads(toks).alias("heads")]


def looks_dual(a, b, ratio: float = 0.82, containment: float = 0.7, coverage: float = 0.6, least_chars: int = 8, reaches=dice_reaches) -> Column:
    """Are two readings (indexable by what `features` names) the same text? Equal, one in the other, enough shared
    tokens, or a high enough measure, tried in this order."""
    short_len = F.least(a["norm_len"], b["norm_len"])
    within = F.when(a["norm_len"] <= b["norm_len"], F.contains(b["norm"], a["norm"])).otherwise(F.contains(a["norm"], b["norm"]))
    na, nb = F.size(a["toks"]), F.size(b["toks"])
    hits = F.when(na <= nb, fuzzy_hits(a["toks"], b["toks"], b["heads"])).otherwise(fuzzy_hits(b["toks"], a["toks"], a["heads"]))
    few = F.least(na, nb)
    covered = F.least(a["tok_len"] / a["norm_len"], b["tok_len"] / b["norm_len"]) >= coverage
    by_tokens = (few > 0) & (hits >= few * F.lit(containment)) & covered & ((few >= 3) | ((hits == few) & (short_len >= least_chars)))
    return (
        F.when((a["norm_len"] == 0) | (b["norm_len"] == 0), False)
        .when(a["norm"] == b["norm"], True)
        .when((short_len >= least_chars) & within, True)
        .when(by_tokens, True)
        .otherwise(reaches(a, b, ratio))
    )


def wrap_formula(c: Column) -> Column:
    """`$$..$$` around LaTeX that has no delimiter; prose that was taken for a formula stays."""
    delimited = c.contains("$") | c.contains("\\(") | c.contains("\\)") | c.contains("\\[") | c.contains("\\]")
    latex = c.rlike(r"[\\^_{}=]")
    return F.when(latex & ~delimited, F.concat(F.lit("$$"), c, F.lit("$$"))).otherwise(c)


def clean_content(kind: Column, content: Column) -> Column:
    unix = F.replace(F.replace(content, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    titled = F.regexp_replace(F.regexp_replace(unix, rf"^{_SPACE}*#+{_SPACE}*", ""), "</?center>", "")
    text = F.when(kind.isin("doc_title", "paragraph_title", "figure_title"), titled).otherwise(unix)
    text = trim(F.regexp_replace(text, "\n{3,}", "\n\n"))
    return F.when(kind == "formula", wrap_formula(text)).otherwise(text)


def map_type(kind: Column) -> Column:
    """Any service's block type as one of the client's."""
    name = F.regexp_replace(F.lower(trim(kind)), "[ -]", "_")
    names = {k: k for k in CLIENT_TYPES} | SYNONYMS
    return F.coalesce(F.create_map(*map(F.lit, chain.from_iterable(names.items())))[name], F.lit("text"))


def resolve_type(kind: Column, label: Column) -> Column:
    """The block's label if it is a client type as it stands, else what its type stands for; where that is only text, what the
    label stands for."""
    typed = map_type(kind)
    return F.when(label.isin(CLIENT_TYPES), label).when(typed != "text", typed).otherwise(map_type(label))


def is_translatable(kind: Column, content: Column) -> Column:
    return kind.isin(TRANSLATABLE) & ~is_blank(content)


def extract_json(reply: Column) -> Column:
    """The JSON object of a reply: code fences off, from the first `{` to the last `}`; null without one."""
    bare = F.regexp_replace(trim(reply), r"^```[a-zA-Z]*\s*|\s*```$", "")
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def error_message(body: Column, most: int = 300) -> Column:
    """The message of an error body: the first of `detail`, `message` and `error.message` that is a string; of any other body
    the first `most` characters."""
    parsed = F.try_parse_json(body)

    def said(path: str) -> Column:
        found = F.try_variant_get(parsed, path, "variant")
        return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(parsed, path, "string"))

    return F.coalesce(said("$.detail"), said("$.message"), said("$.error.message"), F.left(body, F.lit(most)))


def normalize_url(url: Column) -> Column:
    """Trimmed, without trailing slashes, http where no scheme is given; null if empty or not http(s)."""
    bare = F.regexp_replace(trim(url), "/+$", "")
    full = F.when(bare.contains("://"), bare).otherwise(F.concat(F.lit("http://"), bare))
    return F.when((bare != "") & full.rlike("^https?://"), full)


def is_loopback(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?:[^:/]*://)?(?:[^/?@]*@)?(\[[^\]]*\]|[^:/?]*)", 1)
    return F.regexp_replace(host, r"[\[\]]", "").isin("localhost", "127.0.0.1", "0.0.0.0", "::1")


def version_key(v: Column) -> Column:
    """Numeric segments; what isn't a number counts as 0."""
    return F.transform(F.split(F.regexp_replace(trim(v), "^v+", ""), r"\."), lambda p: F.coalesce(F.regexp_extract(p, "^[0-9]*", 0).try_cast("bigint"), F.lit(0)))


def version_gt(a: Column, b: Column) -> Column:
    """Is version a greater than b? Missing segments count as 0."""
    x, y = version_key(a), version_key(b)
    n = F.greatest(F.size(x), F.size(y))
    pad = lambda k: F.concat(k, F.array_repeat(F.lit(0).cast("bigint"), n - F.size(k)))
    return pad(x) > pad(y)


def decode_data_uri(payload: Column) -> Column:
    """Bytes of a base64 payload with or without a `data:` head; null if it is none."""
    return F.try_to_binary(F.regexp_replace(payload, "^data:[^,]*,", ""), F.lit("base64"))


def retry_class(status: Column) -> Column:
    return F.when(status == 429, "quota").when(status.isin(500, 502, 503, 504), "transient").otherwise("never")


MOST_WAIT, ATTEMPTS = 30.0, 3


def backoff_seconds(attempt: Column, retry_after: Column) -> Column:
    """Wait before the next try: the service's wish if it is a number from 0 on, else powers of two, within 0.1 and 30 s."""
    own = F.when((retry_after >= 0) & (retry_after < F.lit(float("inf"))), retry_after)
    return F.greatest(F.lit(0.1), F.least(F.lit(MOST_WAIT), F.coalesce(own, F.pow(F.lit(2.0), attempt))))


def retry_step(status: Column, attempt: Column, retry_after: Column) -> Column:
    """What follows an error on the attempt (from 0): `fail` where trying again can't help or the tries are used up, `park` for a
    quota that takes longer than one may wait here or has no try left, else `wait`."""
    last, kind = attempt >= ATTEMPTS - 1, retry_class(status)
    long = F.coalesce((retry_after > MOST_WAIT) & (retry_after < F.lit(float("inf"))), F.lit(False))
    return F.when(kind == "never", "fail").when((kind == "quota") & (last | long), "park").when(last, "fail").otherwise("wait")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.replace(c, F.lit("\n"), F.lit("<br>"))


def math_segments(c: Column) -> Column:
    r"""The delimited formulas of a text in order: `$$ $$`, `\[ \]`, `$ $` that touches no space, `\( \)`."""
    return F.regexp_extract_all(c, F.lit(r"(?s)\$\$.+?\$\$|\\\[.+?\\\]|\$(?! )[^$\n]+?(?<! )\$|\\\(.+?\\\)"), 0)

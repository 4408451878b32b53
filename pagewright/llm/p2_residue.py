"""Problem 2: template residue, filler text, error pages and notices that scripts or cookies are needed.

Method: every text is split into units (sentences, and lines and texts of two or three of them); of each, markup, a label in
front, numbers, addresses and dates are masked, and what is left is hashed. The hashes of all units of all texts are grouped
over all sources (books), repeats within a source first, and counted by distinct source. Units that recur in MIN_SOURCES
sources or more are classified by phrase rules: rule "recurring". A unit that recurs in fewer is none, wherever it stands:
prose that talks about such things names its own places and people and so doesn't recur.

Rule "placeholder" needs no recurrence, as its marks have no other use: unfilled fields, filler of pseudo-Latin words, keyboard
runs. Both rules look at whole texts.

Nulls and empty texts are no cases; a record that comes twice is one row; columns beside those named below are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, cut_lineage, map_arrow, nested_blocks, strings, table

#: A message counts if it recurs in this many sources.
MIN_SOURCES = 3
#: Types and labels whose text is code, formula or table.
NOT_PROSE = ["table", "formula", "formula_number", "algorithm", "code", "equation", "image", "chart"]

# Markup of template fields.
FIELD = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^{}\n]{1,60}%\}|<%[^<>\n]{1,60}%>|[$#]\{\s*[^\W\d]\w*(?:[.\s]\w+)*\s*\}"
    r"|(?<![\\A-Za-z0-9^_}$#{])\{\s*[^\W\d]\w*(?:[ .]\w+){0,3}\s*\}(?!\})|(?<![\d%])%[^\W\d]\w{2,40}%(?![\d%])"
    r"|(?<![A-Za-z0-9_])__[^\W\d_][^\W_]*(?:_[^\W_]+)*__(?!_)|\[\[\s*[^\W\d]\w*(?:[ .]\w+)*\s*\]\]|<<\s*[^\W\d]\w*(?:[ .]\w+)*\s*>>"
    r"|\*\|\s*[^\W\d]\w*\s*\|\*|@@[^\W\d]\w*@@|(?<![A-Za-z0-9])@Model\.\w+|«\s*(?:[a-z]+_\w+|[a-z]+[A-Z]\w*|[A-Z][A-Z_]{2,}|[a-z]+|[A-Z][a-z]+)\s*»"
    r"|\[\s*(?i:insert|enter|your|add|put)\b[^\]\n]{1,60}\]|\[[^\[\]\n]{1,60}\s(?i:tbd|tba|todo|here)\s*\]|<\s*(?i:enter|insert|your|add)\s[^<>\n]{1,60}>",
    re.S,
)
#: A field's name in guillemets is told from a quoted word by its spelling (camel case, underscore or capitals).
QUOTED = re.compile(r"«\s*([a-z]+_\w+|[a-z]+[A-Z]\w*|[A-Z][A-Z_]{2,})\s*»")

# Phrases by family. A sentence is a message if a rule's families all occur.
FAMILIES = {
    "script": "javascript|java script|noscript|scripts|scripting|script is|скрипт|脚本|cookie|ad blocker|adblock|werbeblocker",
    "switch": "enable|turn on|turned off|switch|activ|aktivier|habilit|включи|отключ|启用|禁用|disabled|allow|needs|require|must be on|block|reload|erforderlich|nécessaire|necesari|нужн|需要",
    "web": "page|server|gateway|service|request|session|address|handler|site|url|seite|página|страниц|сервер|页面|网页|服务|/doc/|/p/|/archive/|/reader/|http",
    "fails": "not found|could not find|cannot be found|can't be found|unavailable|denied|forbidden|try again|try later|introuvable|nicht gefunden|nicht verfügbar|не найден|недоступ|запрещ|不存在|已被删除|无法访问|找不到|leads nowhere|has ended|has expired|log in again|sign in again|too many requests|unhandled exception|null reference|no answer in time|timed out|timeout|no encontrad|no se encuentra|no existe|no disponible|n'existe pas|n’existe pas|indisponible|abgelaufen|server fault|server error|bad gateway|stack trace",
    "filler": "your text goes here|text goes here|placeholder text|dummy paragraph|dummy text|content will follow|for layout purposes|sample body copy|replace this paragraph|with your own words|texte provisoire|à remplacer avant|steht später der richtige text|blindtext|platzhaltertext|texto de relleno|texto provisional|texto de ejemplo|текст-заполнитель|текст заполнитель|здесь будет текст|占位文字|占位文本|占位符|asdf|qwer|lorem ipsum|texte de remplissage|faux texte",
}
RULES = [{"script", "switch"}, {"web", "fails"}, {"filler"}]
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
#: Words of the filler text that no language of the library uses, to look for it at all.
LOREM_MARKS = ["lorem", "ipsum", "eiusmod", "nostrud", "ullamco", "cillum", "fugiat", "aliqua", "veniam", "pariatur"]
KEYBOARD = re.compile(r"(?:(?<!\w)([xX])\1{3,}(?!\w)\W*){2,}|(?:(?<!\w)(?:asdf|qwer|jkl|zxcv|hjkl)(?!\w)\W*){2,}", re.I)

_TAGS = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>")
_LABEL = re.compile(r"^\s*[^\W\d_]{2,12}\s?[:：]\s", re.M)
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\w+|(?<!\w)/[\w./-]+")
_NUMBER = re.compile(r"\d+(?:[-./:,]\d+)*")  # dates as well
_REST = re.compile(r"[^\w@]+|_+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*(?=\S)")
_LINES = re.compile(r"\n+")
_WORD = re.compile(r"[^\W\d_]+")
#: A message has no more sentences than this.
SENTENCES = 3


def masked(text: str) -> str:
    """A text in lower case without markup and labels, its addresses, dates and numbers masked."""
    if "<" in text:
        text = _TAGS.sub(" ", text)
    if ":" in text or "：" in text:
        text = _LABEL.sub("", text)
    if "/" in text or "@" in text or "www." in text:
        text = _ADDRESS.sub(" @ ", text)
    return _NUMBER.sub("0", text).lower()


def normal(unit: str) -> str:
    """What makes two masked units the same: their words and masks."""
    return _REST.sub(" ", unit).strip()


def units(text: str) -> list[str]:
    """The units of a masked text: sentences, lines of several, and the text if it is a few lines."""
    out, lines, n = [], [x for x in _LINES.split(text) if x.strip()], 0
    for line in lines:
        parts = _SENTENCE.split(line)
        n += len(parts)
        out += parts
        if 1 < len(parts) <= SENTENCES:
            out.append(line)
    if 1 < len(lines) and n <= SENTENCES:
        out.append(text)
    return out


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for family, words in FAMILIES.items():
        for w in words.split("|"):
            a.add_word(w, a.get(w, frozenset()) | {family})
    for w in LOREM_MARKS:
        a.add_word(w, a.get(w, frozenset()) | {"lorem"})
    for w in ["xxxx", "asdf", "qwer", "zxcv"]:
        a.add_word(w, a.get(w, frozenset()) | {"keys"})
    for w in ["{{", "{%", "<%", "${", "#{", "{", "%", "__", "[[", "<<", "*|", "@@", "@model.", "«", "[", "<"]:
        a.add_word(w, a.get(w, frozenset()) | {"field"})
    a.make_automaton()
    return a


def families(text: str) -> set[str]:
    found: set[str] = set()
    for _, f in _automaton().iter(text):
        found |= f
    return found


def is_lorem(text: str) -> bool:
    words = _WORD.findall(text.lower())
    return len(words) >= 5 and sum(w in LOREM for w in words) >= 0.6 * len(words)


def placeholders(text: str, found: set[str]) -> list[str]:
    """The marks of rule "placeholder" in a text with the anchors `found`."""
    out = []
    if "field" in found and any(not m.group().startswith("«") or QUOTED.match(m.group()) for m in FIELD.finditer(text)):
        out.append("<field>")
    if "lorem" in found and any(is_lorem(p) for p in _LINES.split(text)):
        out.append("<lorem>")
    if "keys" in found and KEYBOARD.search(text):
        out.append("<keys>")
    return out


def messages(text: str) -> list[tuple[str, bool]]:
    """(message, is it a placeholder?) of a text: what is a case at once, and what is one if it recurs."""
    found = families(text.lower())
    out = [(m, True) for m in placeholders(text, found)] if found else []
    if any(rule <= found for rule in RULES):
        out += [(normal(u), False) for u in units(masked(text)) if any(rule <= families(u) for rule in RULES)]
    return out


def _scan(whole: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    rows: list[int] = []
    found: list[str] = []
    sure: list[bool] = []
    for i, text in enumerate(strings(whole.column("content"))):
        if text:
            for m, placeholder in messages(text):
                rows.append(i)
                found.append(m)
                sure.append(placeholder)
    take = whole.take(pa.array(rows, type=pa.int64()))
    return batch(schema, take.column("record_kind"), take.column("record_id"), take.column("block_pos"), take.column("source"), found, [hashed(m) for m in found], sure)


def hashed(message: str) -> int:
    return xxhash.xxh64_intdigest(message.encode("utf-8", "surrogatepass")) - (1 << 63)


def recurring(texts: DataFrame, min_sources: int = MIN_SOURCES, held: int = 1_000_000) -> DataFrame:
    """texts(source, content) -> (message_id, sources) of the units that recur in so many sources. Repeats within a source are
    taken out in the partition, so a unit that stands in a third of all texts comes to the shuffle once a partition and source."""
    schema = pa.schema([("message_id", pa.int64()), ("source", pa.int64())])

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for b in batches:
            for text, source in zip(strings(b.column("content")), b.column("source").to_pylist(), strict=True):
                if text:
                    seen.update([(hashed(n), source) for u in units(masked(text)) if (n := normal(u))])
                if len(seen) >= held:
                    yield batch(schema, *zip(*seen, strict=True))
                    seen = set()
        if seen:
            yield batch(schema, *zip(*seen, strict=True))

    pairs = texts.select(F.xxhash64("source").alias("source"), "content").mapInArrow(run, "message_id bigint, source bigint")
    spread = pairs.repartition("message_id").groupBy("message_id").agg(F.countDistinct("source").alias("sources"))
    return spread.filter(F.col("sources") >= min_sources)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "blocks").filter(~F.col("type").isin(NOT_PROSE) | F.col("type").isNull())
    nested = nested_blocks(spark, sf_dir).filter(
        ~F.coalesce(F.lower("b.type"), F.lit("")).isin(NOT_PROSE) & ~F.coalesce(F.lower("b.label"), F.lit("")).isin(NOT_PROSE)
    )
    return blocks.select(F.lit("block").alias("record_kind"), F.col("block_id").alias("record_id"), "block_pos", F.col("book_id").alias("source"), "content").unionAll(
        nested.select(F.lit("service_page"), "service_page_id", "block_pos", "book_id", "b.content")
    )


CANDIDATE = "record_kind string, record_id bigint, block_pos int, source string, message string, message_id bigint, placeholder boolean"


def residue(texts: DataFrame, min_sources: int = MIN_SOURCES) -> DataFrame:
    """texts(record_kind, record_id, block_pos, source, content) -> (record_kind, record_id, block_pos, source, message, rule) of
    the records that hold residue."""
    texts = texts.select("record_kind", "record_id", "block_pos", "source", "content")
    found = cut_lineage(map_arrow(texts, _scan, CANDIDATE))
    wide = recurring(texts, min_sources).select("message_id")
    recur = found.filter(~F.col("placeholder")).join(wide, "message_id", "left_semi").withColumn("rule", F.lit("recurring"))
    return found.filter("placeholder").withColumn("rule", F.lit("placeholder")).unionByName(recur).drop("message_id", "placeholder")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(texts(spark, sf_dir)).select("record_kind", "record_id", "block_pos").distinct()


def p2_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The residue's messages and the rule that takes them, with records and sources."""
    each = residue(texts(spark, sf_dir)).groupBy("rule", "message")
    return each.agg(F.countDistinct("record_kind", "record_id", "block_pos").alias("records"), F.countDistinct("source").alias("sources"))


QUERIES = {"p2_found": p2_found, "p2_messages": p2_messages}
SQL: dict[str, str] = {}

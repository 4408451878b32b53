"""Problem 9: text decoded with the wrong character encoding, and its restoration.

Method: minimum description length. For every paragraph with other than ASCII characters, each chain of "encode as what it
was wrongly read in, decode as what it was" that applies is a candidate: up to three steps, of which up to two legacy ones
may follow each other, and one may precede each step of UTF-8. A candidate's length is that of its zstandard compression with
the best language's dictionary plus a cost for each step. The shortest wins; the paragraph is left as it is unless a chain
saves more than its cost. Replacement characters show a wrong decoding that can't be undone; what is left of such a paragraph
is restored as far as a chain explains it.

Candidates are found for all paragraphs of a batch at once: a chain of one-byte encodings is a map of characters, so one
product of the paragraphs' character counts with the code lengths of all chains' outcomes gives each outcome's length by
single characters; one with the bytes' roles in UTF-8 tells which can be UTF-8. Only an outcome whose single characters take no
more than the paragraph's own is compressed: others are longer by any measure. Whatever reads as UTF-8 without loss is a step
on the way, however unlikely.

Characters are counted over all documents. Dictionaries are trained on paragraphs of about SAMPLE_CHARS characters a language;
paragraphs that a chain turns into clearly more usual characters stay out, so that an encoding that is often wrong isn't
learned. Null, empty and ASCII texts are no cases; every paragraph of a text is looked at; repeated rows give one row.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, cut_lineage, map_arrow, slices, strings, table
from .vec import codes, mix

#: Characters are known from this share of a language's characters on; the others have a code length of UNSEEN nats.
SEEN = 1e-7
UNSEEN = 17.0
#: An outcome is compressed if its characters' code length is less than the paragraph's own by this for each of its other than
#: ASCII characters.
GAIN = 0.25
SAMPLE_CHARS = 300_000
DICTIONARY_BYTES = 48 * 1024
LEAST_DOCUMENTS = 20
#: Bytes that each step of a chain costs (none where one-byte characters read as valid UTF-8, which chance doesn't bring
#: about), and that a chain must save beyond them.
STEP_COST = 2
LEAST_SAVED = 1
LOST = "�"

# Fixed values: (read as, written in). Both are names of Python's codecs; "win" is cp1252 with the five unused bytes kept.
STEPS = [
    ("win", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("cp1251", "utf-8"), ("koi8_r", "utf-8"), ("cp866", "utf-8"), ("gbk", "utf-8"), ("cp1250", "utf-8"), ("iso8859_2", "utf-8"), ("iso8859_15", "utf-8"), ("big5", "utf-8"), ("cp932", "utf-8"), ("mac_cyrillic", "utf-8"),
    ("cp850", "win"), ("cp437", "win"), ("mac_roman", "win"), ("cp1251", "win"), ("koi8_r", "win"), ("cp1250", "win"), ("cp866", "win"), ("win", "cp850"), ("win", "cp437"), ("win", "mac_roman"), ("mac_roman", "cp850"), ("gbk", "win"),
    ("win", "cp1251"), ("cp866", "cp1251"), ("koi8_r", "cp1251"), ("mac_roman", "cp1251"), ("cp850", "cp1251"), ("cp437", "cp1251"), ("mac_cyrillic", "cp1251"),
    ("win", "koi8_r"), ("cp1251", "koi8_r"), ("cp866", "koi8_r"), ("win", "cp866"), ("cp1251", "cp866"), ("koi8_r", "cp866"),
    ("win", "gbk"), ("mac_roman", "gbk"), ("cp1251", "gbk"), ("cp437", "gbk"), ("cp850", "gbk"), ("big5", "gbk"), ("win", "big5"), ("gbk", "big5"),
]


@lru_cache(maxsize=None)
def _bytes_of(codec: str) -> dict[str, bytes]:
    """Character to byte of a one-byte codec; bytes without a character stand for themselves."""
    name = "cp1252" if codec == "win" else codec
    out = {}
    for b in range(256):
        out.setdefault(bytes([b]).decode(name, "ignore") or chr(b), bytes([b]))
    if codec == "win":  # text read as Latin-1 has control characters instead
        for b in range(128, 160):
            out.setdefault(chr(b), bytes([b]))
    return out


@lru_cache(maxsize=None)
def _chars_of(codec: str) -> str:
    name = "cp1252" if codec == "win" else codec
    return "".join(bytes([b]).decode(name, "ignore") or chr(b) for b in range(256))


_WIDE = {"gbk", "big5", "cp932", "utf-8"}


def even(text: str) -> bytes:
    """UTF-8 in which the characters that take two bytes are moved to where it takes three, so that no alphabet counts as shorter."""
    c = _code_points(text)
    return np.where((c >= 0x80) & (c < 0x800), c + np.uint32(0xE000), c).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


def cost(read_as: str, written_in: str) -> int:
    return 0 if written_in == "utf-8" and read_as not in _WIDE else STEP_COST


def step(text: str, read_as: str, written_in: str) -> str | None:
    """The text as it would be had it been decoded right; None where it can't have been read so."""
    if LOST in text and written_in != "utf-8" and written_in not in _WIDE:  # what is lost stays so
        parts = [p if p.isascii() else step(p, read_as, written_in) for p in text.split(LOST)]
        out = None if None in parts else LOST.join(parts)
        return out if out != text else None
    try:
        if read_as in _WIDE:
            raw = b"\xff".join(part.encode(read_as) for part in text.split(LOST)) if LOST in text else text.encode(read_as)
        else:
            table_ = _bytes_of(read_as)
            raw = b"".join([table_[c] if c != LOST else b"\xff" for c in text])
    except (KeyError, UnicodeEncodeError):
        return None
    if written_in == "utf-8":
        try:
            out = raw.decode("utf-8")
        except UnicodeDecodeError:
            out = raw.decode("utf-8", "replace")
            if out.count(LOST) > max(text.count(LOST) * 3, len(out) * 0.05):
                return None
    elif written_in in _WIDE:
        out = raw.decode(written_in, "replace")
        if out.count(LOST) > text.count(LOST) * 2:
            return None
    else:
        out = raw.decode("latin-1").translate(dict(enumerate(_chars_of(written_in))))
    return out if out != text else None


#: Legacy steps that may follow each other, and steps altogether.
LEGACY_IN_A_ROW = 2
MOST_STEPS = 3


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _script(text: str) -> str:
    c = _code_points(text)
    han, cyr = int(((c >= 0x4E00) & (c <= 0x9FFF)).sum()), int(((c >= 0x400) & (c <= 0x4FF)).sum())
    return "zh" if han * 3 > cyr and han else "ru" if cyr * 8 > len(text) else ""


def script_of(char: str) -> str:
    """The first word of a letter's Unicode name: LATIN, CYRILLIC, CJK and so on; nothing for other characters."""
    return unicodedata.name(char, "").split(" ")[0] if char.isalpha() else ""


class Chains:
    """All chains of one-byte encodings as maps over their common alphabet: `legacy` from character to character, `unicode`
    from character to byte of UTF-8 (with at most one legacy step before)."""

    def __init__(self):
        one_byte = sorted({c for pair in STEPS for c in pair if c not in _WIDE})
        chars = sorted({c for e in one_byte for c in _chars_of(e) if c > "\x7f"} | {c for e in one_byte for c in _bytes_of(e) if c > "\x7f"})
        self.alphabet = np.array([ord(c) for c in chars])
        self.place = np.full(0x110000, len(chars), dtype=np.int32)  # the last column: none of the alphabet
        self.place[self.alphabet] = np.arange(len(chars))
        pairs = [(r, w) for r, w in STEPS if r not in _WIDE and w not in _WIDE]
        single = {}
        for r, w in pairs:
            own, to = _bytes_of(r), _chars_of(w)
            single[r, w] = np.array([ord(to[own[c][0]]) if c in own else -1 for c in chars])
        self.legacy: list[tuple[tuple, np.ndarray]] = []
        seen = {self.alphabet.tobytes()}
        layer = [((), self.alphabet)]
        for _ in range(LEGACY_IN_A_ROW):
            after = []
            for steps, m in layer:
                for pair, then in single.items():
                    out = np.where(m >= 0, np.append(then, -1)[self.place[np.maximum(m, 0)]], -1)
                    if out.tobytes() not in seen and (out >= 0).any():
                        seen.add(out.tobytes())
                        after.append(((*steps, pair), out))
            self.legacy += after
            layer = after
        self.unicode: list[tuple[tuple, np.ndarray]] = []
        seen = set()
        for steps, m in [((), self.alphabet), *(x for x in self.legacy if len(x[0]) == 1)]:
            for r, w in STEPS:
                if w == "utf-8" and r not in _WIDE:
                    own = _bytes_of(r)
                    byte = np.array([own[chr(x)][0] if x >= 0 and chr(x) in own else -1 for x in m.tolist()])
                    if byte.tobytes() not in seen:
                        seen.add(byte.tobytes())
                        self.unicode.append(((*steps, (r, w)), byte))
        maps = np.stack([m for _, m in self.legacy], axis=1)
        self.invalid = np.vstack([maps < 0, np.ones((1, maps.shape[1]), bool)])
        self.targets = np.vstack([np.maximum(maps, 0), np.zeros((1, maps.shape[1]), maps.dtype)]).astype(np.uint32)
        byte = np.stack([m for _, m in self.unicode], axis=1)
        self.follows = np.vstack([(byte >= 0x80) & (byte < 0xC0), np.zeros((1, byte.shape[1]), bool)]).astype(np.float32)
        needs = np.select([byte < 0, byte < 0xC2, byte < 0xE0, byte < 0xF0, byte < 0xF5], [1e6, (byte >= 0xC0) * 1.0, 1.0, 2.0, 3.0], 1.0)
        self.needs = np.vstack([needs, np.full((1, byte.shape[1]), 1e6)]).astype(np.float32)
        role = np.select([byte < 0, byte < 0xC0, byte < 0xC2, byte < 0xE0, byte < 0xF0, byte < 0xF5], [5, 1, 5, 2, 3, 4], 5)  # 1 follows, 2 to 4 begin
        self.roles = np.vstack([role, np.full((1, role.shape[1]), 5), np.zeros((1, role.shape[1]))]).astype(np.int8)


    def read_as_unicode(self, code: np.ndarray, maps: np.ndarray, block: int = 20_000) -> list[int]:
        """Those of the maps under which at least half of the other than ASCII bytes are whole sequences of UTF-8."""
        place = np.append(np.where(code > 0x7F, self.place[code], len(self.alphabet) + 1), [len(self.alphabet) + 1] * 3)
        whole, high = np.zeros(len(maps)), np.zeros(len(maps))
        for at in range(0, len(code), block):  # a text of any length in blocks, each with the three bytes that may follow
            size = min(block, len(code) - at)
            r = self.roles[place[at : at + size + 3, None], maps]
            follows = r == 1
            high += (r[:size] != 0).sum(axis=0)
            for n in (1, 2, 3):
                begins = r[:size] == n + 1
                for k in range(1, n + 1):
                    begins &= follows[k : size + k]
                whole += (n + 1) * begins.sum(axis=0)
        return maps[whole * 2 >= np.maximum(high, 1)].tolist()


@lru_cache(maxsize=1)
def chains() -> Chains:
    return Chains()


class Judge:
    """Characters' code lengths by script and compression dictionaries by language; decides on paragraphs."""

    def __init__(self, dictionaries: dict[str, bytes], nats: dict[str, dict[str, float]]):
        self.dictionaries, self.nats, self.compressors, self.tables = dictionaries, nats, None, None

    def __getstate__(self) -> tuple:
        return self.dictionaries, self.nats

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _ready(self) -> dict:
        if self.compressors is None:
            import zstandard

            self.compressors = {}
            for lang, raw in self.dictionaries.items():
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=3)
                self.compressors[lang] = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.compressors = self.compressors or {"": zstandard.ZstdCompressor(level=3, write_content_size=False)}
        return self.compressors

    def _by_script(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each script: nats of each code point (0 of what is lost), and of what each legacy chain makes of the alphabet."""
        if self.tables is None:
            self.tables, of = [], chains()
            for known in self.nats.values() or [{}]:
                t = np.full(0x110000, UNSEEN, dtype=np.float32)
                t[[ord(c) for c in known]] = list(known.values())
                t[ord(LOST)] = 0
                self.tables.append((t, np.where(of.invalid, 1e6, t[of.targets]).astype(np.float32)))
        return self.tables

    def nats_of(self, text: str) -> float:
        """The text's code length by single characters of the script that suits it best."""
        code = _code_points(text)
        return min(float(t[code].sum()) for t, _ in self._by_script())

    def length(self, text: str, lang: str) -> int:
        c, script, raw = self._ready(), _script(text), even(text)
        if script in c:
            langs = [script]
        else:
            langs = [x for x in c if x not in ("zh", "ru")]
            langs = [x for x in langs if x in (lang, "en")] if lang in langs else langs
        return min(len(c[x].compress(raw)) for x in langs or list(c))

    def candidates(self, texts: list[str]) -> list[list[tuple[str, tuple, bool]]]:
        """For each text the decodings by one more chain: (decoding, its steps, may it be right?). It may if its characters'
        code length is less than the text's own; what reads as UTF-8 without loss can be a step on the way."""
        of, tables = chains(), self._by_script()
        flat, start, end = codes(texts)
        row = np.repeat(np.arange(len(texts)), end - start + 1)
        is_lost = flat == ord(LOST)
        high = (flat > 0x7F) & ~is_lost
        beside = np.zeros(len(flat), bool)
        beside[:-1] |= high[1:]
        beside[1:] |= high[:-1]
        k = len(of.alphabet) + 1
        h = np.bincount(row[high] * k + of.place[flat[high]], minlength=len(texts) * k).reshape(len(texts), k).astype(np.float32)
        n = h.sum(axis=1)
        lost = np.bincount(row[is_lost], minlength=len(texts))
        runs = np.bincount(row[high & beside], minlength=len(texts)) * 2 >= n
        ascii_ = ~high & ~is_lost & (flat != 0)
        plain = [np.bincount(row[ascii_], weights=t[flat[ascii_]], minlength=len(texts)) for t, _ in tables]
        own = np.min([a + np.bincount(row[high], weights=t[flat[high]], minlength=len(texts)) for a, (t, _) in zip(plain, tables, strict=True)], axis=0)
        limit = own - GAIN * n
        may = np.zeros((len(texts), len(of.legacy)), bool)
        used = np.flatnonzero(h.any(axis=0))
        for a, (_, by_chain) in zip(plain, tables, strict=True):
            rows = np.flatnonzero(limit > a)  # elsewhere the ASCII characters alone take more in this script
            may[rows] |= h[np.ix_(rows, used)] @ by_chain[used] <= (limit - a)[rows, None]
        out: list[list] = [[] for _ in texts]
        for i in np.flatnonzero(may.any(axis=1)).tolist():
            which, own_chars = np.flatnonzero(may[i]), np.flatnonzero(h[i])
            with np.errstate(over="ignore"):
                same = (of.targets[own_chars][:, which].astype(np.uint64) * mix(own_chars.astype(np.uint64))[:, None]).sum(axis=0)
            code = flat[start[i] : end[i]]
            place = of.place[code]
            inside = place < k - 1
            for m in sorted(which[np.unique(same, return_index=True)[1]].tolist()):  # of chains that do the same to this text the shortest
                turned = code.copy()
                turned[inside] = of.targets[place[inside], m]
                if not np.array_equal(turned, code):
                    out[i].append((turned.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), of.legacy[m][0], True))
        rows = np.flatnonzero(runs)
        follow = h[np.ix_(rows, used)] @ of.follows[used]
        may = (follow >= 1) & (np.abs(follow - h[np.ix_(rows, used)] @ of.needs[used]) <= 0.5 * follow + 3 * lost[rows, None])
        which = [(i, m) for i, own_maps in zip(rows.tolist(), may, strict=True) if own_maps.any() for m in of.read_as_unicode(flat[start[i] : end[i]], np.flatnonzero(own_maps))]
        for i, m in which:
            steps, text = of.unicode[m][0], texts[i]
            for pair in steps:
                text = step(text, *pair) if text is not None else None
            if text is not None:
                whole = text.count(LOST) <= lost[i]
                # what is lost counts as two unseen characters, so that losing doesn't pay
                fits = self.nats_of(text) + 2 * UNSEEN * max(0, text.count(LOST) - int(lost[i])) <= limit[i]
                if (fits and (whole or len(steps) == 1)) or whole:
                    out[i].append((text, steps, fits))
        for i in np.flatnonzero((h[:, -1] > 0) | runs).tolist():
            for pair in STEPS:
                if pair[0] in _WIDE or pair[1] in _WIDE and pair[1] != "utf-8" and runs[i] and h[i, -1] == 0:
                    text = step(texts[i], *pair)
                    if text is not None:
                        fits = self.nats_of(text) + UNSEEN * max(0, text.count(LOST) - int(lost[i])) <= limit[i]
                        if fits or pair[1] == "utf-8" and text.count(LOST) <= lost[i]:
                            out[i].append((text, (pair,), fits))
        return out

    def explained(self, paragraphs: list[str]) -> list[bool]:
        """Does a chain give each paragraph clearly more usual characters? Such don't show what a language is like."""
        return [any(fits for _, _, fits in found) for found in self.candidates(paragraphs)]

    def restore(self, paragraphs: list[str], langs: list[str]) -> list[tuple[str, str]]:
        """(text, chain) of each; the chain is empty where the paragraph stays."""
        best = [(p, "") for p in paragraphs]
        least: list = [None] * len(paragraphs)
        seen: list[set] = [{p} for p in paragraphs]
        layer = [(i, p, ()) for i, p in enumerate(paragraphs)]
        while layer:
            after = []
            for (i, _, before), found in zip(layer, self.candidates([t for _, t, _ in layer]), strict=True):
                for text, more, fits in found:
                    steps = before + more
                    if text in seen[i] or len(steps) > MOST_STEPS:
                        continue
                    seen[i].add(text)
                    if more[-1][1] in _WIDE or more[-1][0] in _WIDE:  # legacy chains are complete as they are
                        after.append((i, text, steps))
                    paid = sum(cost(*pair) for pair in steps)
                    if not fits or (len(steps) > 1 and paid and text.count(LOST) > paragraphs[i].count(LOST)):
                        continue  # a chain with legacy encodings that loses characters explains nothing
                    if least[i] is None:
                        least[i] = self.length(paragraphs[i], langs[i]) - LEAST_SAVED
                    n = self.length(text, langs[i]) + paid
                    if n < least[i]:
                        least[i] = n
                        best[i] = text, ", ".join(f"{w} read as {r}" for r, w in steps)
            layer = [x for x in after if len(x[2]) < MOST_STEPS]
        return best


def _lang(column: str = "lang"):
    return F.coalesce(F.lower(F.trim(column)), F.lit("und"))


def _counts(b: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """(lang, char, n): how often each character stands in a language; an empty char counts all of them, a null the documents."""
    texts, langs = strings(b.column("text")), np.array(strings(b.column("lang")), dtype=object)
    out: list[tuple] = []
    for lang in sorted(set(langs)):
        own = [texts[i] for i in np.flatnonzero(langs == lang)]
        flat, _, _ = codes(own)
        code, n = np.unique(flat[flat > 0], return_counts=True)
        out += [(lang, "", len(flat)), (lang, None, len(own))] + [(lang, chr(c), k) for c, k in zip(code.tolist(), n.tolist(), strict=True) if not 0xD800 <= c < 0xE000]
    return batch(schema, *zip(*out, strict=True))


def _sample(shares: dict[str, float]):
    def run(b: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        import xxhash

        rows = []
        for lang, t in zip(strings(b.column("lang")), strings(b.column("text")), strict=True):
            most = int(shares.get(lang, 0) * 2**64)
            if most:
                rows += [(lang, p) for p in t.split("\n") if p and xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) < most]
        return batch(schema, *zip(*rows, strict=True)) if rows else None

    return run


def judge(documents: DataFrame, sample_chars: int = SAMPLE_CHARS) -> Judge:
    """Fitted on `documents`: character counts over all texts, dictionaries on paragraphs of about `sample_chars` characters a
    language, drawn by hash from all over the texts."""
    import zstandard

    texts = documents.select("text", _lang().alias("lang")).filter("text is not null")
    counts = cut_lineage(map_arrow(texts, _counts, "lang string, char string, n bigint").groupBy("lang", "char").agg(F.sum("n").alias("n")))
    known = counts.filter((F.col("lang") != "und") & F.col("char").isNull() & (F.col("n") >= LEAST_DOCUMENTS)).select("lang")
    totals = counts.join(known, "lang", "left_semi").filter("char = ''").select("lang", F.col("n").alias("total"))
    each = counts.filter("char <> ''").join(F.broadcast(totals), "lang").filter(F.col("n") >= F.col("total") * SEEN)
    nats: dict[str, dict[str, float]] = {}
    by_lang: dict[str, dict[str, float]] = {}
    for r in each.select("lang", "char", (-F.log(F.col("n") / F.col("total"))).alias("nats")).collect():  # at most all of Unicode for each language
        by_lang.setdefault(r["lang"], {})[r["char"]] = r["nats"]
    for own in by_lang.values():  # a language belongs to the script of most of its letters; a script has its languages' shortest codes
        weight: dict[str, float] = {}
        for c, x in own.items():
            weight[script_of(c)] = weight.get(script_of(c), 0.0) + float(np.exp(-x))
        weight.pop("", None)
        of_script = nats.setdefault(max(weight, key=weight.get) if weight else "", {})
        for c, x in own.items():
            of_script[c] = min(x, of_script.get(c, UNSEEN))
    sizes = {r["lang"]: r["total"] for r in totals.collect()}
    found = Judge({}, nats)
    samples: dict[str, list[str]] = {}
    for r in map_arrow(texts, _sample({k: min(0.9999, sample_chars / n) for k, n in sizes.items()}), "lang string, text string").collect():
        samples.setdefault(r["lang"], []).append(r["text"])
    for lang, every in sorted(samples.items()):
        every = sorted(set(every))
        s = [even(p) for p, bad in zip(every, found.explained(every), strict=True) if not bad and LOST not in p]
        try:
            found.dictionaries[lang] = zstandard.train_dictionary(DICTIONARY_BYTES, s, level=3).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the samples themselves serve
            if s:
                found.dictionaries[lang] = b"".join(s)[-DICTIONARY_BYTES:]
    return found


def restored(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text, lang) -> (doc_id, text, chains, lost) of the documents with a wrongly decoded paragraph."""
    sent = documents.sparkSession.sparkContext.broadcast(judge(documents))  # a few dictionaries of DICTIONARY_BYTES

    def run(whole: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        ids, texts, chains_, lost = [], [], [], []
        for b in slices(whole, "text", 400_000):
            doc_ids, every, langs = b.column("doc_id").to_pylist(), strings(b.column("text")), strings(b.column("lang"))
            where, paragraphs, of = [], [], []
            parts = {}
            for i, t in enumerate(every):
                if t and not t.isascii():
                    parts[i] = t.split("\n")
                    for k, p in enumerate(parts[i]):
                        if not p.isascii():
                            where.append((i, k))
                            paragraphs.append(p)
                            of.append(langs[i])
            names: dict[int, set] = {}
            for (i, k), (text, chain) in zip(where, sent.value.restore(paragraphs, of) if paragraphs else [], strict=True):
                if chain:
                    parts[i][k] = text
                    names.setdefault(i, set()).add(chain)
            for i in parts:
                if i in names or LOST in every[i]:
                    ids.append(doc_ids[i])
                    texts.append("\n".join(parts[i]))
                    chains_.append(sorted(names.get(i, ())))
                    lost.append(LOST in texts[-1])
        return batch(schema, ids, texts, chains_, lost)

    ddl = "doc_id bigint, text string, chains array<string>, lost boolean"
    return map_arrow(documents.select("doc_id", "text", _lang().alias("lang")), run, ddl)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored(table(spark, sf_dir, "documents")).dropDuplicates(["doc_id"])


QUERIES = {"p9_found": p9_found, "p9_restored": p9_restored}
SQL: dict[str, str] = {}

"""Problem 1: broken pairs of content and translation: empty, truncated, refusal, copied, wrong_language.

Method: a multi-label linear classifier (logistic, one label a defect) on hashed n-grams of the response (for wrong_language
one label for each language asked for) and on pair features. It is trained on SAMPLE to twice as many pairs of the data, every
n-th by hash, of which those that keep the content's names, length and sentences are taken as good, and on defective ones made
from them (each language has its part of the sample, at least OF_LANGUAGE pairs where it has them): cut, copied, swapped for one in another language, refused. Pairs that the first fit holds for defective leave the
good ones, and it is fitted again. Thresholds are calibrated on a part of the pairs that isn't trained on, for defects PRIOR as
frequent as good pairs. An `empty` response has no letter or digit, or only a word for nothing; the model isn't asked. Of
several defects the first of empty, copied, refusal, wrong_language, truncated is given.

A null translation, a null content and tables are no cases, nor are contents of codes and numbers that stay as they are;
a page without a language asked for has no wrong_language. Redelivered blocks give one row. The sample is the only bound;
every pair is classified, over its whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, map_arrow, slices, strings, table
from .vec import Words, char_grams, codes

SAMPLE = 3000
BITS = 15
PRIOR = 0.02
SEED = 11
DEFECTS = ["copied", "refusal", "truncated"]
#: Fewer pairs than this can't be learned from: of such a table only `empty` ones come out.
LEAST_PAIRS = 20
#: Pairs of a language that are sampled even if it is rare; with fewer than LEAST_OF_LANGUAGE nothing can be learned of it.
OF_LANGUAGE, LEAST_OF_LANGUAGE = 300, 12

# Words for nothing, labels in front of an answer, marks of a cut, and what refusals are made of.
NOTHING = re.compile(r"[\W_]*(?:null|none|nil|nan|n/?a|undefined|empty|no text|no content|无|空|нет|vacío|vide|leer)?[\W_]*", re.I)
LABELS = ["Translation: ", "A: ", "Output:\n", "Answer: ", "Response: ", "译文：", "翻译：", "Übersetzung: ", "Traduction : ", "Traducción: ", "Перевод: ", "> ", "» ", "- "]
CUT_MARKS = ["", "", "", "", "...", "…", " [...]", " -"]
CODE = re.compile(r"[A-Z]{1,4}|\d+")
STOPS = re.compile(r"[。！？]|[.!?](?=[\s\"'”’»)]|$)")
ENDED = re.compile(r"[.。!?！？:：;；][\s\"'’”»)\]）」』|]*$")
MARKED = re.compile(r"(?:\.\.\.|…|\[\.\.\.\]|\[…\]|-)\s*$")
ENTITY = re.compile(r"[A-Z]{1,4}-\d+|\d+|[A-Z][a-z]{3,}")
REFUSALS = {
    "en": (
        ["", "I'm sorry, but ", "Sorry, ", "My apologies, ", "Unfortunately, ", "I'm afraid ", "Thank you for the page, but ", "As an AI language model, ", "As an assistant for books, ", "As a translator, I see that ", "Regrettably, "],
        ["I cannot translate this text", "I can't help with translating this passage", "I am not able to process the text you sent", "I must decline to render this", "translating {e} is beyond my remit", "the passage on {e} is not something I can translate", "this request falls outside of what I may do, so no translation follows", "I have been told not to answer requests such as this one", "this content is restricted, so I will leave it alone", "I would rather not work on this material", "this text may not be rendered by me", "the material on {e} can't be handled here", "my guidelines don't allow me to work on this item", "I won't be able to provide a version of this content", "no translation available: the request was declined by the service", "I do not feel comfortable translating this", "it is against my policy to translate such content", "I refuse to translate the section about {e}", "I will not supply a translated version of this paragraph", "no rendering of this block can be given", "the request about {e} exceeds what is permitted", "this is not something I am willing to put into another language"],
        [".", ". Please send something else.", "; kindly try a different block.", ". Is there another page I could look at?", ". Let me know if I can help otherwise."],
    ),
    "zh": (["", "抱歉，", "很抱歉，", "对不起，", "作为语言助手，", "作为人工智能，"], ["我不能翻译这段内容", "我无法处理有关 {e} 的请求", "{e} 的内容我不便处理", "根据规定，此文本不予翻译", "我无法提供该文本的译文", "这一请求超出了我的权限", "本段内容受限，拒绝翻译", "该请求不在允许范围之内", "因此不提供译文", "暂时不能提供该段的中文版本", "此内容不便翻译", "恕不翻译关于 {e} 的段落", "我不会给出这一段的译文", "对此不提供任何版本"], ["。", "。请提供其他内容。", "，请换一段。"]),
    "de": (["", "Leider ", "Es tut mir leid, ", "Als Assistent "], ["kann ich diesen Text nicht übersetzen", "darf ich diesen Abschnitt leider nicht übersetzen", "muss ich die Anfrage zu {e} ablehnen", "diesen Inhalt darf ich nicht bearbeiten", "ist mir die Übersetzung dieses Absatzes nicht erlaubt", "diese Anfrage liegt außerhalb dessen, was ich tun darf", "zu {e} gebe ich keine Übersetzung heraus", "für diesen Absatz stelle ich keine Fassung bereit", "hierzu kann ich nichts liefern", "diese Bitte lehne ich ab"], [".", ". Bitte senden Sie etwas anderes.", "; bitte versuchen Sie einen anderen Absatz."]),
    "fr": (["", "Désolé, ", "Je regrette, mais ", "Malheureusement, ", "En tant qu’assistant, "], ["je ne peux pas traduire ce passage", "je dois refuser la demande sur {e}", "je ne suis pas autorisé à traduire ce texte", "la traduction de ce contenu m’est interdite", "cette demande dépasse ce que je peux faire", "je ne fournis pas de version de ce passage", "aucune traduction ne sera donnée pour {e}", "ce texte ne peut être rendu ici", "je préfère ne pas traiter ce bloc"], [".", ". Merci d’envoyer autre chose."]),
    "es": (["", "Lo siento, ", "Lamentablemente, ", "Como asistente, "], ["no puedo traducir este pasaje", "debo rechazar la solicitud sobre {e}", "no estoy autorizado a traducir este texto", "no me está permitido traducir este contenido", "esta petición queda fuera de lo que puedo hacer", "no ofrezco una versión de este párrafo", "no habrá traducción de lo relativo a {e}", "este texto no puede ser vertido aquí", "prefiero no tratar este bloque"], [".", ". Envíe otra cosa, por favor."]),
    "ru": (["", "Извините, ", "К сожалению, ", "Как помощник, "], ["я не могу перевести этот фрагмент", "перевод этого текста мне не разрешён", "я вынужден отклонить запрос о {e}", "я не вправе обрабатывать этот материал", "этот запрос выходит за рамки моих возможностей", "перевод этого отрывка не предоставляется", "о {e} я ничего не могу сообщить", "я не буду переводить этот абзац", "версию этого текста я дать не могу"], [".", ". Пришлите другой текст."]),
}


def has_text(s: str) -> bool:
    return NOTHING.fullmatch(s) is None


def plain(s: str) -> str:
    return "".join(c for c in s.lower() if c.isalnum())


def is_code(content: str) -> bool:
    """Only numbers and short runs of capitals."""
    return all(CODE.fullmatch(w) for w in re.findall(r"[^\W\d_]+|\d+", content))


def own_lines(content: str, answer: str) -> tuple[str, str]:
    """Both texts without the lines they have in common (notices kept verbatim), if any text is left of both."""
    if "\n" not in answer and "\n" not in content:
        return content, answer
    x, y = content.split("\n"), answer.split("\n")
    both = {t.strip() for t in x} & {t.strip() for t in y}
    if not both:
        return content, answer
    x, y = "\n".join(t for t in x if t.strip() not in both), "\n".join(t for t in y if t.strip() not in both)
    return (x, y) if has_text(x) and has_text(y) else (content, answer)


def _units(s: str) -> set:
    w = re.findall(r"[぀-鿿]|[^\W_]+", s.lower())
    return set(zip(w, w[1:], strict=False))


def _weight(s: str) -> float:
    """Length in letters; a Han character says as much as about three others."""
    han = sum("぀" <= c <= "鿿" for c in s) if not s.isascii() else 0
    return len(s) + 2.0 * han


FEATURES = ["bias", "copy", "copied", "kept", "no_entity", "last_missing", "missing_tail", "unended", "mark", "short_z", "long_z", "ratio_half", "fewer_stops", "stops_missing", "short", "kept_none", "none_ended", "none_unended", "title_kept"]


def features(content: str, answer: str, common: frozenset) -> list[float]:
    full = _units(content)
    copy = len(full & _units(answer)) / len(full) if full else float(plain(content) == plain(answer))
    px, py = plain(content), plain(answer)
    copied = bool(px) and (px == py or (py.endswith(px) and len(py) - len(px) <= 24) or (copy >= 0.9 and len(py) <= 1.4 * len(px) + 24))
    x, y = own_lines(content, answer)
    entities = [e for e in ENTITY.findall(x) if e not in common]
    there = [e in y for e in entities]
    kept = sum(there) / len(there) if there else 1.0
    tail = 0
    for t in reversed(there):
        if t:
            break
        tail += 1
    stops_x, stops_y = len(STOPS.findall(x)), len(STOPS.findall(y))
    z = float(np.log((_weight(y) + 5) / (_weight(x) + 5)))
    less = max(0, stops_x - stops_y) / max(stops_x, 1)
    ended = ENDED.search(x) is not None
    return [
        1.0, copy, float(copied), kept, float(not entities), float(tail > 0), tail / max(len(there), 1), float(ended and not ENDED.search(y)), float(MARKED.search(y) is not None and not MARKED.search(x)),
        max(0.0, -z), max(0.0, z), float(z < -0.7), less, float(less > 0), float(len(y) < 170), float(bool(entities) and kept < 0.34),
        float(bool(entities) and not any(there) and ENDED.search(y) is not None), float(bool(entities) and not any(there) and not ENDED.search(y)), float(not ended and bool(there) and there[-1] and z > -0.6),
    ]


def is_sound(f: list[float]) -> bool:
    """May the pair serve as a good one to train on? It keeps the content's names and numbers, length and sentences."""
    v = dict(zip(FEATURES, f, strict=True))
    return v["copy"] < 0.5 and v["kept"] >= 0.5 and not v["last_missing"] and not v["unended"] and not v["mark"] and not v["stops_missing"] and v["short_z"] < 0.7 and v["long_z"] < 0.9


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, first n-gram of each text and the end): 3-grams of letters and words, digits masked."""
    low = [re.sub(r"\d+", "0", t.lower()) or " " for t in texts]
    flat, start, end = codes(low)
    g = char_grams(flat, 3)
    inside = np.ones(len(flat), dtype=bool)
    inside[end] = False
    row = np.repeat(np.arange(len(low)), end - start + 1)[inside]
    w = Words(low)
    bucket = np.concatenate([g[inside], w.hash]) >> np.uint64(64 - BITS)
    rows = np.concatenate([row, w.row])
    order = np.argsort(rows, kind="stable")
    return bucket[order].astype(np.int64), np.searchsorted(rows[order], np.arange(len(low) + 1))


class Model:
    """Linear scores: `defects` from n-grams and pair features, `languages` from n-grams alone."""

    def __init__(self, languages: list[str], common: frozenset):
        self.languages, self.common = languages, common
        self.w = np.zeros((1 << BITS, len(DEFECTS) + len(languages)), dtype=np.float32)
        self.v = np.zeros((len(FEATURES), self.w.shape[1]), dtype=np.float32)
        self.limits = np.zeros(self.w.shape[1])

    def scores(self, bucket: np.ndarray, first: np.ndarray, pair: np.ndarray) -> np.ndarray:
        n = np.diff(first)
        out = np.add.reduceat(self.w[bucket], np.minimum(first[:-1], max(len(bucket) - 1, 0)), axis=0) / np.sqrt(np.maximum(n, 1))[:, None]
        return out + pair @ self.v

    def fit(self, bucket: np.ndarray, first: np.ndarray, pair: np.ndarray, labels: np.ndarray, weight: np.ndarray, passes: int = 6, rate: float = 0.15, size: int = 256) -> None:
        """AdaGrad on the logistic loss in small batches; `weight` is 0 where a label isn't asked of an example."""
        rng = np.random.default_rng(SEED)
        n = np.diff(first)
        scale = (1 / np.sqrt(np.maximum(n, 1))).astype(np.float32)
        passes = max(passes, -(-320 * size // max(len(n), 1)))  # few examples are gone through more often
        gw, gv = np.full_like(self.w, 0.05), np.full_like(self.v, 0.05)
        for _ in range(passes):
            order = rng.permutation(len(n))
            for at in range(0, len(order), size):
                rows = order[at : at + size]
                m = n[rows]
                f = np.concatenate([[0], np.cumsum(m)])
                b = bucket[np.repeat(first[:-1][rows] - f[:-1], m) + np.arange(f[-1])]
                z = np.clip(self.scores(b, f, pair[rows]), -30, 30)
                d = ((1 / (1 + np.exp(-z)) - labels[rows]) * weight[rows]).astype(np.float32)
                by = np.argsort(b, kind="stable")
                own = np.repeat(np.arange(len(rows)), m)[by]
                sorted_b = b[by]
                start = np.flatnonzero(np.concatenate([[True], sorted_b[1:] != sorted_b[:-1]]))
                u = sorted_b[start]
                dw = np.add.reduceat((d * scale[rows][:, None])[own], start, axis=0) + 1e-5 * self.w[u]
                dv = pair[rows].T @ d
                gw[u] += dw * dw
                gv += dv * dv
                self.w[u] -= rate * dw / np.sqrt(gw[u])
                self.v -= rate * dv / np.sqrt(gv)


def _refusal(rng: np.random.Generator, lang: str, entities: list[str]) -> str:
    openers, cores, closers = REFUSALS[lang if lang in REFUSALS and rng.random() < 0.5 else "en"]
    core = cores[rng.integers(len(cores))].format(e=entities[rng.integers(len(entities))] if entities else "this")
    text = openers[rng.integers(len(openers))] + core + closers[rng.integers(len(closers))]
    return text[:1].upper() + text[1:]


def _cut(rng: np.random.Generator, y: str) -> str:
    stops = [m.end() for m in STOPS.finditer(y)][:-1]
    if stops and rng.random() < 0.4:
        return y[: stops[rng.integers(len(stops))]]
    most = 0.9 if ENDED.search(y) else 0.5  # of a title without a stop only a large loss shows
    return y[: max(1, int(len(y) * rng.uniform(0.1, most)))].rstrip() + CUT_MARKS[rng.integers(len(CUT_MARKS))]


def _copy(rng: np.random.Generator, x: str) -> str:
    kind = rng.integers(5)
    if kind == 1:
        return x.upper() if rng.random() < 0.5 else x.lower()
    if kind == 2:
        return x.rstrip(" .。!?")
    if kind == 3:
        return LABELS[rng.integers(len(LABELS))] + x
    return re.sub(" ", "  ", x) if kind == 4 else x


def train(pairs: list[tuple[str, str, str]]) -> Model:
    """pairs: (content, answer, language asked for)."""
    rng = np.random.default_rng(SEED)
    pairs = [(x, y, lang) for x, y, lang in pairs if x and y and has_text(y) and not is_code(x)]
    seen: dict[str, int] = {}
    for x, _, _ in pairs:
        for e in set(ENTITY.findall(x)):
            if e.isalpha():
                seen[e] = seen.get(e, 0) + 1
    common = frozenset(e for e, n in seen.items() if n >= max(4, 0.002 * len(pairs)))
    count: dict[str, int] = {}
    for _, _, lang in pairs:
        count[lang] = count.get(lang, 0) + 1
    languages = sorted(k for k, n in count.items() if n >= LEAST_OF_LANGUAGE)
    sound = [p for p in pairs if is_sound(features(p[0], p[1], common))]
    pairs = sound if len(sound) >= LEAST_PAIRS else pairs
    languages = [k for k in languages if any(p[2] == k for p in pairs)]
    if len(pairs) < LEAST_PAIRS:
        model = Model(languages, common)
        model.limits[:] = np.inf
        return model
    by_lang = {k: [p for p in pairs if p[2] == k] for k in languages}
    model = Model(languages, common)
    nd, k = len(DEFECTS), len(DEFECTS) + len(languages)
    texts, pair, labels, weights, origin = [], [], [], [], []

    def add(x: str, y: str, defect: int | None, lang: str | None, i: int) -> None:
        label, weight = np.zeros(k), np.zeros(k)
        if defect is not None and defect >= 0:
            label[defect] = 1
        if defect is not None:
            weight[:nd] = 1
        if lang in languages:
            weight[nd:] = 1
            label[nd:] = 1
            label[nd + languages.index(lang)] = 0  # label of language l: the answer is NOT in l
        texts.append(own_lines(x, y)[1])
        pair.append(features(x, y, common))
        labels.append(label)
        weights.append(weight)
        origin.append(i)

    for i, (x, y, lang) in enumerate(pairs):
        entities = [e for e in ENTITY.findall(x) if e not in common and e.isalpha()]
        add(x, y, -1, lang, i)
        add(x, _copy(rng, x), 0, None, i)
        add(x, _refusal(rng, lang, entities), 1, None, i)
        c = _cut(rng, y)
        if has_text(c) and len(c) < len(y) - 1:
            add(x, c, 2, lang if len(c) > 40 else None, i)
        if len(y) > 30:  # short texts, as titles are, tell their language too
            at = int(rng.integers(0, len(y) - 15))
            add(x, y[at : at + int(rng.integers(15, 46))].strip() or y, None, lang, i)
        others = [o for o in languages if o != lang]
        if others:
            pool = by_lang[others[rng.integers(len(others))]]
            o = pool[rng.integers(len(pool))]
            add(x, o[1], None, o[2], i)
    bucket, first = grams(texts)
    pair, labels, weights, origin = np.array(pair, np.float32), np.array(labels), np.array(weights), np.array(origin)
    held = origin % 4 == 0
    good = np.zeros(len(texts), bool)
    good[[j for j in range(len(texts)) if weights[j, 0] and not labels[j, :nd].any()]] = True

    def part(rows: np.ndarray) -> tuple:
        n = np.diff(first)[rows]
        f = np.concatenate([[0], np.cumsum(n)])
        idx = np.repeat(first[:-1][rows] - f[:-1], n) + np.arange(f[-1])
        return bucket[idx], f, pair[rows], labels[rows], weights[rows]

    clean = np.ones(len(texts), bool)
    for again in range(2):
        rows = np.flatnonzero(~held & clean)
        model.w[:], model.v[:] = 0, 0
        model.fit(*part(rows))
        if not again:
            z = model.scores(bucket, first, pair)
            asked = np.array([languages.index(pairs[i][2]) + nd if pairs[i][2] in languages else -1 for i in origin])
            wrong = np.where(asked >= 0, z[np.arange(len(z)), asked], -1)
            clean = ~(good & ((z[:, :nd] > 0.5).any(axis=1) | (wrong > 0.5)))
            # answers in a wrong language mislead the languages' labels in whatever was made from them
            bad = set(origin[good & (wrong > 0.5)].tolist())
            clean &= ~(np.isin(origin, list(bad)) & (weights[:, nd:].any(axis=1) if languages else False))
    rows = np.flatnonzero(held & clean)
    z, lab, wt = model.scores(*part(rows)[:3]), labels[rows], weights[rows]
    for j in range(k):
        pos = np.sort(z[(wt[:, j] > 0) & (lab[:, j] > 0), j])
        neg = np.sort(z[(wt[:, j] > 0) & (lab[:, j] == 0) & (good[rows] if j < nd else True), j])
        if not len(pos) or not len(neg):
            model.limits[j] = np.inf
            continue
        grid = np.unique(np.concatenate([pos, neg, [0.0]]))
        grid = np.concatenate([grid, (grid[1:] + grid[:-1]) / 2])
        hit = 1 - np.searchsorted(pos, grid) / len(pos)
        false = (1 - np.searchsorted(neg, grid) / len(neg)) + 0.5 / len(neg)
        f1 = 2 * PRIOR * hit / (PRIOR * hit + false + PRIOR)
        best = grid[f1 >= 0.985 * f1.max()]  # as good as the best; taken from the middle
        model.limits[j] = float(best.min() + 0.45 * (best.max() - best.min()))
    return model


def _classify(sent):
    def run(whole: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        model: Model = sent.value
        nd = len(DEFECTS)
        fixed, wrong = [], []
        for b in slices(whole, "translation", 600_000):
            x, y = strings(b.column("content")), strings(b.column("translation"))
            kind: list[str | None] = [None if has_text(a) else "empty" for a in y]
            live = [i for i in range(len(y)) if kind[i] is None and not is_code(x[i])]
            bad = [[False] * len(model.languages) for _ in y]
            if live:
                pair = np.array([features(x[i], y[i], model.common) for i in live], np.float32)
                z = model.scores(*grams([own_lines(x[i], y[i])[1] for i in live]), pair) > model.limits
                for i, r in zip(live, z.tolist(), strict=True):
                    kind[i] = "copied" if r[0] else "refusal" if r[1] else "truncated" if r[2] else None
                    bad[i] = r[nd:]
            fixed += kind
            wrong += bad
        cols = [whole.column(c) for c in ("block_id", "book_id", "page_index")]
        return pa.RecordBatch.from_arrays([*cols, pa.array(fixed, pa.string()), pa.array(wrong, schema.field(4).type)], schema=schema)

    return run


def defects(pairs: DataFrame, pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """pairs(block_id, book_id, page_index, content, translation), pages(book_id, page_index, target_lang) -> (block_id, defect)."""
    pairs = pairs.filter("translation is not null and content is not null")
    asked = pages.select("book_id", "page_index", F.lower(F.trim("target_lang")).alias("lang")).dropDuplicates(["book_id", "page_index"])
    some = pairs.select("block_id", "book_id", "page_index", "content", "translation")
    placed = some.select("block_id", "book_id", "page_index").join(asked, ["book_id", "page_index"], "left").withColumn("lang", F.coalesce("lang", F.lit("und")))
    sizes = {r["lang"]: r["count"] for r in placed.groupBy("lang").count().collect()}  # a row a language
    # of each language every n-th pair by hash, its part of the sample but at least OF_LANGUAGE where it has them
    total = sum(sizes.values())
    nth = {lang: max(1, n // max(OF_LANGUAGE, sample * n // max(total, 1))) for lang, n in sizes.items()}
    every = F.coalesce(F.create_map(*[F.lit(x) for pair in nth.items() for x in pair])[F.col("lang")], F.lit(1)) if nth else F.lit(1)
    chosen = cut_lineage(placed.filter(F.pmod(F.xxhash64("block_id"), every) == 0).select("block_id", "lang").dropDuplicates(["block_id"]))
    rows = some.join(F.broadcast(chosen), "block_id").dropDuplicates(["block_id"]).collect()
    rows.sort(key=lambda r: r["block_id"])
    model = train([(r["content"], r["translation"], r["lang"] or "und") for r in rows])
    sent = pairs.sparkSession.sparkContext.broadcast(model)
    ddl = "block_id bigint, book_id string, page_index int, defect string, wrong array<boolean>"
    scored = map_arrow(pairs.select("block_id", "book_id", "page_index", "content", "translation"), _classify(sent), ddl)
    scored = scored.filter("defect is not null or exists(wrong, w -> w)").join(asked, ["book_id", "page_index"], "left")
    place = F.array_position(F.array(*map(F.lit, model.languages)), F.col("lang")) if model.languages else F.lit(0)
    is_wrong = F.coalesce(F.when(place > 0, F.try_element_at("wrong", place.cast("int"))), F.lit(False))
    first = F.when(F.col("defect").isin("empty", "copied", "refusal"), F.col("defect")).when(is_wrong, F.lit("wrong_language")).otherwise(F.col("defect"))
    return scored.select("block_id", first.alias("defect")).filter("defect is not null").distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "blocks").filter(F.col("type").isNull() | (F.col("type") != "table"))
    return defects(blocks, table(spark, sf_dir, "page_info"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translated blocks by the language asked for, and their defects."""
    blocks = table(spark, sf_dir, "blocks").filter("(type is null or type <> 'table') and translation is not null").select("block_id", "book_id", "page_index").distinct()
    asked = table(spark, sf_dir, "page_info").select("book_id", "page_index", "target_lang").dropDuplicates(["book_id", "page_index"])
    j = blocks.join(asked, ["book_id", "page_index"], "left").join(p1_found(spark, sf_dir), "block_id", "left")
    return j.groupBy("target_lang", F.coalesce("defect", F.lit("good")).alias("defect")).agg(F.count("*").alias("blocks"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL: dict[str, str] = {}

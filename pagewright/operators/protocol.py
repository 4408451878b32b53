"""A page's talk with a translating model, as a state machine that runs in Arrow batches of pages.

At most ROUNDS answers; one may ask for the neighbour's context, which is given once; an answer that doesn't fit the requests
is sent back; what the last round doesn't settle has failed. The model is a function of (requests, context, round) -> reply
text; it is pluggable, and deterministic in tests."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

ROUNDS = 4


def parse(reply: str) -> dict | None:
    bare = re.sub(r"^```[a-zA-Z]*\s*|\s*```$", "", reply.strip())
    m = re.search(r"\{.*\}", bare, re.S)
    try:
        out = json.loads(m.group()) if m else None
    except ValueError:
        return None
    return out if isinstance(out, dict) else None


def shape(table: str) -> list[int] | None:
    """Cells of each row of a table's payload; null for other texts."""
    try:
        asked = json.loads(table)
    except ValueError:
        return None
    rows = asked.get("table") if isinstance(asked, dict) else None
    return [len(r) for r in rows] if isinstance(rows, list) and all(isinstance(r, list) for r in rows) else None


def fitting(value: str, cells: list[int]) -> str | None:
    """A table's value in the one form it is kept in, if it has the rows and cells asked for; else null."""
    try:
        got = json.loads(value)
    except ValueError:
        return None
    rows = got.get("table") if isinstance(got, dict) else got
    if not isinstance(rows, list) or [len(r) if isinstance(r, list) else -1 for r in rows] != cells:
        return None
    if any(isinstance(c, (list, dict)) for r in rows for c in r):
        return None
    word = lambda c: c if c is None or isinstance(c, str) else json.dumps(c)
    return json.dumps([[word(c) for c in r] for r in rows], ensure_ascii=False, separators=(",", ":"))


def values(reply: dict, asked: list[str], texts: list[str], are_tables: list[bool]) -> dict[str, str | None] | None:
    items = reply.get("result")
    if not isinstance(items, list) or len(items) != len(asked):
        return None
    out = {}
    for i in items:
        if not isinstance(i, dict) or i.get("index") is None:
            return None
        a = i.get("A", i.get("content"))
        out[str(i["index"])] = a if a is None or isinstance(a, str) else json.dumps(a, ensure_ascii=False)
    if sorted(out) != sorted(asked):
        return None
    for index, text, is_table in zip(asked, texts, are_tables, strict=True):
        if is_table and out[index] is not None:
            out[index] = fitting(out[index], shape(text) or [])
            if out[index] is None:
                return None
    return out


def external(reply: dict, given: list[str] | None) -> tuple[int, str] | None:
    """(place among the candidates that were given, text): what the reply says of one of them; null if it says nothing of any."""
    index, said = reply.get("external_index"), reply.get("external")
    place = str(index) if isinstance(index, (str, int)) and not isinstance(index, bool) else ""
    fine = isinstance(said, str) and given is not None and place.isdigit() and int(place) < len(given)
    return (int(place), said) if fine else None


def talk(asked: list[str], texts: list[str], context: dict[str, list[str]], model: Callable, are_tables: list[bool] | None = None) -> tuple[str, int, dict, tuple[str, int, str] | None]:
    """(state, rounds, values by index, (side, candidate, text) of a neighbour's block): done, or failed for `no json`, `mismatch`
    or `context again`. A reply that asks for context is a request even if it brings a result."""
    given: list[str] | None = None
    from_side, why = "", "no json"
    for n in range(1, ROUNDS + 1):
        reply = parse(model(dict(zip(asked, texts, strict=True)), given, n))
        side = (reply or {}).get("need_context")
        if reply is None:
            why = "no json"
        elif side in ("before", "after") and given is not None:
            why = "context again"
        elif side in ("before", "after"):
            given, from_side = context.get(side, []), side
        else:
            got = values(reply, asked, texts, are_tables or [False] * len(asked))
            if got is not None:
                beyond = external(reply, given)
                return "done", n, got, (from_side, *beyond) if beyond else None
            why = "mismatch"
    return why, ROUNDS, {}, None


def run_pages(pages: DataFrame, model: Callable) -> DataFrame:
    """pages(book_id, page_index, asked array<string>, texts array<string>, before array<string>, after array<string>,
    tables array<boolean>) -> (book_id, page_index, state, rounds, answers, side, candidate, external): with the last three, what
    the reply says of a neighbour's block, by its place among the candidates."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                side = {k: list(v) if v is not None else [] for k, v in (("before", r.before), ("after", r.after))}
                state, rounds, got, beyond = talk(list(r.asked), list(r.texts), side, model, list(r.tables))
                out.append((r.book_id, r.page_index, state, rounds, sum(v is not None for v in got.values()), *(beyond or (None, None, None))))
            frame = pd.DataFrame(out, columns=["book_id", "page_index", "state", "rounds", "answers", "side", "candidate", "external"])
            yield frame.astype({"candidate": "Int32"})

    return pages.mapInPandas(run, "book_id string, page_index int, state string, rounds int, answers int, side string, candidate int, external string")

"""Table contents to rectangular grids and back, as array expressions; the HTML scanner keeps state and is an Arrow UDF.

A grid is struct(cols, rows array<struct(cells array<struct(text, colspan)>)>). What holds no table, and what is larger than
the caps, gives null."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.text import trim

# The marks of a cell, and how large a grid may be.
MARK = "<(?:fcel|ecel|lcel|ucel|xcel)>"
MAX_ROWS, MAX_SLOTS, MAX_CELLS = 200, 64, 4000
GRID = "struct<cols:int,rows:array<struct<cells:array<struct<text:string,colspan:int>>>>>"


def _cell(text: Column, colspan) -> Column:
    return F.struct(text.alias("text"), (colspan if isinstance(colspan, Column) else F.lit(colspan)).cast("int").alias("colspan"))


def _line_cells(line: Column) -> Column:
    """Cells of a line of marks: <lcel> widens the cell to its left, every other mark makes a cell of what follows it."""
    marks = F.regexp_extract_all(line, F.lit(f"({MARK})"), 1)
    texts = F.transform(F.slice(F.split(line, MARK), F.lit(2), F.size(marks)), trim)
    pairs = F.arrays_zip(marks.alias("mark"), texts.alias("text"))
    empty = F.array().cast("array<struct<text:string,colspan:int>>")

    def step(cells: Column, p: Column) -> Column:
        n = F.size(cells)
        last = F.element_at(cells, -1)
        wider = F.concat(F.slice(cells, F.lit(1), n - 1), F.array(_cell(last["text"], last["colspan"] + 1)))
        return F.when(p["0"] != "<lcel>", F.concat(cells, F.array(_cell(p["1"], 1)))).when(n > 0, wider).otherwise(F.array(_cell(F.lit(""), 1)))

    return F.aggregate(F.transform(pairs, lambda p: F.struct(p["mark"].alias("0"), p["text"].alias("1"))), empty, step)


def slots(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(0), lambda n, c: n + c["colspan"])


def pad(rows: Column) -> Column:
    """The grid of rows (arrays of cells): short rows get one blank cell for the missing slots; null beyond the caps."""
    cols = F.array_max(F.transform(rows, slots))
    cells = F.aggregate(rows, F.lit(0), lambda n, r: n + F.size(r))
    full = F.transform(rows, lambda r: F.struct(F.when(slots(r) < cols, F.concat(r, F.array(_cell(F.lit(""), cols - slots(r))))).otherwise(r).alias("cells")))
    fine = (F.size(rows) > 0) & (F.size(rows) <= MAX_ROWS) & (cols > 0) & (cols <= MAX_SLOTS) & (cells <= MAX_CELLS)
    return F.when(fine, F.struct(cols.cast("int").alias("cols"), full.alias("rows")))


def parse_marks(content: Column) -> Column:
    lines = F.filter(F.transform(F.split(content, "<nl>"), trim), lambda x: x.rlike(MARK))
    return pad(F.transform(lines, _line_cells))


_TAG = re.compile(r"<([^>]*)>")


def html_rows(content: str) -> list[list[tuple[str, int]]] | None:
    """Rows of the first HTML table: (text, colspan). Cells and rows close where the next one opens; slots that a rowspan
    covers in later rows come as blank cells."""
    start = content.lower().find("<table")
    if start < 0:
        return None
    rows: list[list[tuple[str, int]]] = []
    covered: list[int] = []
    row: list[tuple[str, int]] = []
    slot, in_row, cell = 0, False, None

    def fill() -> None:
        nonlocal slot
        while slot < len(covered) and covered[slot] > 0:
            covered[slot] -= 1
            row.append(("", 1))
            slot += 1

    def flush() -> None:
        nonlocal cell, slot
        if cell is None:
            return
        fill()
        text, wide, deep = cell
        wide = min(wide, MAX_SLOTS)
        if deep > 1:
            covered.extend([0] * (slot + wide - len(covered)))
            covered[slot : slot + wide] = [min(deep - 1, MAX_ROWS)] * wide
        slot += wide
        row.append((_cell_text(text), wide))
        cell = None

    def end_row() -> None:
        nonlocal row, slot
        fill()
        rows.append(row)
        row, slot = [], 0

    def number(tag: str, name: str) -> int:
        m = re.search(name + r"\s*=\s*[\"']*(\d{1,9})", tag, re.I)
        return max(1, int(m.group(1))) if m else 1

    at = start
    for m in _TAG.finditer(content, start):
        if cell is not None:
            cell[0] += content[at : m.start()]
        at = m.end()
        tag = m.group(1)
        closing = tag.startswith("/")
        name = (re.match(r"/*([A-Za-z0-9]*)", tag) or [None, ""])[1].lower()
        if name == "table" and closing:
            break
        if name in ("tr", "td", "th"):
            flush()
            if name == "tr":
                if in_row:
                    end_row()
                in_row = not closing
            elif not closing:
                cell = ["", number(tag, "colspan"), number(tag, "rowspan")]
        elif name == "br" and cell is not None:
            cell[0] += "\n"
    flush()
    if in_row:
        end_row()
    return rows or None


def _cell_text(raw: str) -> str:
    text = re.sub(r"<[^>]*>?", "", raw)
    for name in ("nbsp", "lt", "gt", "quot", "#39", "amp"):
        text = text.replace(f"&{name};", " " if name == "nbsp" else html.unescape(f"&{name};"))
    return " ".join(text.split())


def html_grid(content: str | None) -> dict | None:
    """The grid of the first HTML table, padded and checked against the caps as grids of marks are."""
    rows = html_rows(content) if content else None
    if not rows:
        return None
    cols = max(sum(n for _, n in r) for r in rows)
    if not 0 < cols <= MAX_SLOTS or len(rows) > MAX_ROWS or sum(map(len, rows)) > MAX_CELLS:
        return None
    full = [[*r, ("", cols - n)] if (n := sum(w for _, w in r)) < cols else r for r in rows]
    return {"cols": cols, "rows": [{"cells": [{"text": t, "colspan": n} for t, n in r]} for r in full]}


_CELL = T.StructType([T.StructField("text", T.StringType()), T.StructField("colspan", T.IntegerType())])
_ROW = T.StructType([T.StructField("cells", T.ArrayType(_CELL))])


@F.pandas_udf(T.StructType([T.StructField("cols", T.IntegerType()), T.StructField("rows", T.ArrayType(_ROW))]))
def parse_html(content: pd.Series) -> pd.DataFrame:
    found = [html_grid(c) or {"cols": None, "rows": None} for c in content]
    return pd.DataFrame(found, columns=["cols", "rows"])


def parse_any(content: Column) -> Column:
    """Marks first, HTML second; the scanner only sees what has a table tag and no marks."""
    scanned = parse_html(F.when(content.rlike("(?i)<table") & ~content.rlike(MARK), content))
    return F.when(content.rlike(MARK), parse_marks(content)).when(scanned["cols"].isNotNull(), scanned)


def row_lengths(grid: Column) -> Column:
    return F.transform(grid["rows"], lambda r: F.size(r["cells"]))


def matrix(grid: Column) -> Column:
    return F.transform(grid["rows"], lambda r: F.transform(r["cells"], lambda c: c["text"]))


def payload(grid: Column) -> Column:
    """What is sent to be translated: {"table": [[cell, ..], ..]}."""
    return F.when(grid.isNotNull(), F.to_json(F.struct(matrix(grid).alias("table"))))


def source_matrix(grid: Column) -> Column:
    return F.when(grid.isNotNull(), F.to_json(matrix(grid)))


def translated_matrix(translation: Column, grid: Column) -> Column:
    """The translated cells, if there are as many rows and cells as in the grid; else null. A cell that isn't text is null."""
    rows = F.coalesce(F.from_json(translation, "array<array<string>>"), F.from_json(F.get_json_object(translation, "$.table"), "array<array<string>>"))
    same = F.size(rows) == F.size(grid["rows"])
    fits = F.forall(F.arrays_zip(F.transform(rows, F.size).alias("a"), row_lengths(grid).alias("b")), lambda p: p["a"] == p["b"])
    return F.when(same & fits, rows)


def fitting_matrix(translation: Column, asked: Column) -> Column:
    """The translated cells as a JSON matrix, if there are as many rows and cells as in the payload that was asked; else null."""
    rows, source = F.coalesce(F.from_json(translation, "array<array<string>>"), F.from_json(F.get_json_object(translation, "$.table"), "array<array<string>>")), F.from_json(F.get_json_object(asked, "$.table"), "array<array<string>>")
    return F.when(F.transform(rows, F.size) == F.transform(source, F.size), F.to_json(rows))


def human_text(grid: Column) -> Column:
    """A table to read: cells with ` | ` between, blank cells and lines left out."""
    lines = F.transform(matrix(grid), lambda r: F.array_join(F.filter(r, lambda c: trim(c) != ""), " | "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")

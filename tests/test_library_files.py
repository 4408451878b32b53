"""The library's files: what is written reads back the same, broken files stop the reading."""

import json

import pytest

from pagewright.sources import bound as B


def test_bound_documents(spark, tmp_path):
    grid = {"cols": 2, "rows": [{"cells": [{"text": "a", "colspan": 2}]}]}
    old = {"status": "Processing", "pages": [{"index": 1, "finished": True, "blocks": [{"type": "text", "content": "x\ny", "loc": [1, 2.5, 3, 4], "translation": None}, {"type": "table", "content": "t", "loc": [0, 0, 1, 1], "translation": "[]", "grid": grid}]}, {"index": 2, "finished": False, "translated": True, "blocks": []}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "book1.json").write_text(json.dumps(old, indent=1))
    pages, blocks = B.read_bound(spark, str(tmp_path / "in"))
    assert sorted(map(tuple, pages.collect())) == [("book1", "Processing", 1, True, False), ("book1", "Processing", 2, False, True)]
    got = {r["block_pos"]: r for r in blocks.collect()}
    assert got[0]["content"] == "x\ny" and got[0]["loc"] == [1.0, 2.5, 3.0, 4.0] and got[0]["grid"] is None and got[1]["grid"]["rows"][0]["cells"][0]["colspan"] == 2
    out = str(tmp_path / "out")
    for _ in range(2):  # written anew over itself
        B.write_pages(B.page_documents(pages, blocks), out)
    again, same = B.read_pages(spark, out)
    assert sorted(map(str, again.collect())) == sorted(map(str, pages.collect()))
    assert sorted(map(str, same.collect())) == sorted(map(str, blocks.collect()))


def test_index(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps({"folders": ["A"], "pdfs": [{"id": "1", "name": "n", "bind": None}]}, indent=1))
    folders, books = B.read_index(spark, str(tmp_path / "index.json"))
    assert [tuple(r) for r in folders.collect()] == [("A",)] and [tuple(r) for r in books.collect()] == [("1", "n", None, None)]
    (tmp_path / "broken.json").write_text('{"folders": [')
    with pytest.raises(Exception, match="(?i)malformed"):
        B.read_index(spark, str(tmp_path / "broken.json"))[0].collect()

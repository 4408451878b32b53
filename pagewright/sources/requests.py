"""What a recognition request may say, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import trim


def parse_page_filter(raw: Column, total: Column) -> Column:
    """struct(error, pages) of a page filter such as "0,2-4" (0-based, both ends in); null selects every page. The error is
    `malformed`, `no page` or `out of range`; pages come sorted and once each."""
    parts = F.filter(F.transform(F.split(raw, ","), trim), lambda p: p != "")
    malformed = F.exists(parts, lambda p: ~p.rlike(r"^\d{1,9}\s*(-\s*\d{1,9})?$"))
    ends = F.transform(parts, lambda p: F.transform(F.split(p, "-"), lambda x: F.coalesce(trim(x).try_cast("int"), F.lit(0))))
    backwards = F.exists(ends, lambda e: F.element_at(e, -1) < e[0])
    bad = malformed | backwards
    beyond = F.exists(ends, lambda e: F.element_at(e, -1) >= total)
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(ends, lambda e: F.sequence(e[0], F.element_at(e, -1))))))
    error = F.when(raw.isNull(), None).when(bad, "malformed").when(F.size(parts) == 0, "no page").when(beyond, "out of range")
    every = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    return F.struct(error.alias("error"), F.when(raw.isNull(), every).when(error.isNull(), pages).alias("pages"))


def select_document(document: Column) -> Column:
    """Which payload a document request carries: `url` and `image` must be data URIs, uploads by id aren't served."""
    kind, url = document["type"], F.coalesce(document["document_url"], document["image_url"])
    return (
        F.when(~kind.isin("document_url", "image_url"), "unsupported")
        .when(url.isNull() | (url == ""), "missing")
        .when(url.rlike("(?i)^https?://"), "remote url refused")
        .when(url.startswith("data:"), "data uri")
        .otherwise("base64")
    )


def batch_pages(advertised: Column) -> Column:
    """Pages a batch may hold: what the service says between 1 and 32, 4 where it says nothing usable."""
    return F.least(F.greatest(F.coalesce(advertised, F.lit(4)), F.lit(1)), F.lit(32))

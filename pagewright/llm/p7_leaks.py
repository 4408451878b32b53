"""Problem 7: evaluation passages that stand, wholly or in part, in training documents.

Method: winnowing. Of the hashes of all runs of GRAM words, every WINDOW consecutive ones keep their least (the rightmost of
equals); any shared run of at least GRAM + WINDOW - 1 = 12 words has a kept hash in common, on both sides the same. The kept
hashes of items and documents are joined, and each meeting pair of an item and a document is extended: it stands if the
whole texts share a run of at least 12 words.

Null or empty texts, and texts of fewer than 12 words, have no run and no row. Repeated rows give one row a pair. An item
that leaks into a third of all documents makes one hit a document, never a group in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, cut_lineage, map_arrow, prefilter, slices, strings, table
from .vec import Words, signed

GRAM = 6
RUN = 12


def _winnow(gram: int, window: int):
    def one(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        w = Words(strings(b.column("text")))
        g, first = w.grams(gram)
        if len(g) < window:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        row = w.row[first]
        n = len(g) - window + 1
        least, at = g[:n].copy(), np.arange(n)
        for j in range(1, window):
            better = g[j : j + n] <= least
            least[better] = g[j : j + n][better]
            at[better] = np.flatnonzero(better) + j
        at = np.unique(at[row[:n] == row[window - 1 : window - 1 + n]])
        return row[at], g[at]

    def run(whole: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch | None:
        ids, prints = [], []
        for b in slices(whole, "text"):
            row, g = one(b)
            pairs = np.unique(np.stack([row.astype(np.uint64), g]), axis=1) if len(row) else np.zeros((2, 0), np.uint64)
            ids.append(b.column("id").take(pa.array(pairs[0].astype(np.int64))))
            prints.append(pairs[1])
        return batch(schema, pa.concat_arrays(ids), signed(np.concatenate(prints)))

    return run


def fingerprints(texts: DataFrame, gram: int = GRAM, run: int = RUN) -> DataFrame:
    """texts(id, text) -> (id, print), the winnowed hashes of each text."""
    return map_arrow(texts.select(F.col("id").cast("bigint").alias("id"), "text"), _winnow(gram, run - gram + 1), "id bigint, print bigint")


def _runs(run: int):
    def of_batch(whole: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        ids, places, prints = [], [], []
        for b in slices(whole, "text"):
            w = Words(strings(b.column("text")))
            g, first = w.grams(run)
            ids.append(b.column("id").take(pa.array(w.row[first])))
            places.append(first - w.first[w.row[first]])
            prints.append(g)
        return batch(schema, pa.concat_arrays(ids), np.concatenate(places).astype(np.int32), signed(np.concatenate(prints)))

    return of_batch


def all_runs(texts: DataFrame, run: int = RUN) -> DataFrame:
    """texts(id, text) -> (id, place, print) of every run of `run` words."""
    return map_arrow(texts.select(F.col("id").cast("bigint").alias("id"), "text"), _runs(run), "id bigint, place int, print bigint")


def leaks(items: DataFrame, documents: DataFrame, gram: int = GRAM, run: int = RUN) -> DataFrame:
    """items(item_id, passage), documents(doc_id, text) -> (item_id, doc_id, item_place, doc_place): where each of the
    items' runs of `run` words stands in a document. A longer shared run is a chain of such rows."""
    items = items.select(F.col("item_id").alias("id"), F.col("passage").alias("text")).filter("text is not null").dropDuplicates()
    documents = documents.select(F.col("doc_id").alias("id"), "text").filter("text is not null and id is not null")
    met = fingerprints(documents, gram, run).join(fingerprints(items, gram, run).select("print").distinct(), "print", "left_semi")
    met = cut_lineage(met.select("id").distinct())
    near = prefilter(documents, "id", met)  # documents that come with them have no run of an item
    there = all_runs(near, run).withColumnsRenamed({"id": "doc_id", "place": "doc_place"})
    return there.join(all_runs(items, run).withColumnsRenamed({"id": "item_id", "place": "item_place"}), "print").select("item_id", "doc_id", "item_place", "doc_place")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "eval_items"), table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("item_id", "doc_id").distinct()


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked items: documents that hold them, longest shared run in words."""
    chain = W.partitionBy("item_id", "doc_id", "shift").orderBy("doc_place")
    rows = _found(spark, sf_dir).distinct().withColumn("shift", F.col("doc_place") - F.col("item_place"))
    rows = rows.withColumn("chain", F.col("doc_place") - F.row_number().over(chain))
    longest = rows.groupBy("item_id", "doc_id", "shift", "chain").agg((F.count("*") + (RUN - 1)).alias("words"))
    hits = longest.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("longest_run"))
    return table(spark, sf_dir, "eval_items").select("item_id", "suite").distinct().join(hits, "item_id")


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
_RUNS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS ws FROM eval_items),
dr AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 11], ' ') AS r FROM d, unnest(range(1, len(ws) - 10)) AS u(k) WHERE len(ws) >= 12),
ir AS (SELECT DISTINCT item_id, array_to_string(ws[k:k + 11], ' ') AS r FROM i, unnest(range(1, len(ws) - 10)) AS u(k) WHERE len(ws) >= 12)
"""
SQL = {"p7_found": _RUNS + "SELECT DISTINCT item_id, doc_id FROM dr JOIN ir USING (r)"}

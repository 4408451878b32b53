"""Problem 8: mixing sources to target shares of all tokens.

Of each mixture, the total is the largest at which every source that has text can give its share within its repeats; shares of
sources without text fall to the others in proportion (the report has them with nothing reached). Every document of a source
then has the same expected number of copies; its whole part is given, its fraction is rounded.

Method: pivotal dependent rounding. Within chunks of a source's documents in order of size, two neighbours' fractions are
paired and mass is moved at random, without changing any expectation, until one of them is 0 or 1; the one left over goes on
to the next. Each chunk's residual goes up a reduction tree, chunk by chunk, until a source has one residual, which is
rounded by its probability. So a source's copies differ from the expected number by less than one, and its tokens by little,
as neighbours are of like size. Chunks hold about CHUNK documents however large the source is.

Documents with null or empty texts have no tokens and no row; sources compare without case and outer spaces; null sources are
none of the named. Chance is a hash of SEED, so a result can be had again.
"""

from __future__ import annotations

import base64
import os
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, cut_lineage, map_arrow, strings, table

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
CHUNK = 2048
FAN = 256
SEED = 20240
# Fixed value: how byte-level BPE vocabularies of this kind split texts into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """documents(doc_id, source, text) -> (doc_id, source, tokens) of the documents that have tokens."""

    def run(b: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        encode = encoding(tokenizer).encode_ordinary
        return batch(schema, b.column("doc_id"), b.column("source"), [len(encode(t)) if t else 0 for t in strings(b.column("text"))])

    return map_arrow(documents.select("doc_id", "source", "text"), run, "doc_id bigint, source string, tokens bigint").filter("tokens > 0")


def pivotal(p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Fractions after pairing each with the one left over so far, and the place of the last left over."""
    out = p.astype(float).copy()
    chance = rng.random(len(out))
    left = 0
    for j in range(1, len(out)):
        a, b = out[left], out[j]
        total = a + b
        if total < 1:
            if total == 0 or chance[j] * total < b:
                out[left], out[j] = 0.0, total
                left = j
            else:
                out[left], out[j] = total, 0.0
        else:
            if (2 - total) > 0 and chance[j] * (2 - total) >= 1 - b:
                out[left], out[j] = total - 1, 1.0
            else:
                out[left], out[j] = 1.0, total - 1
                left = j
    return out, left


def rates(targets: DataFrame, totals: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, source_tokens, rate): the expected copies of each of a source's documents."""
    t = targets.select("mix_id", F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats")
    j = t.join(totals, "source", "left").fillna(0, ["source_tokens", "documents"])
    of_mix = W.partitionBy("mix_id")
    there = F.when((F.col("source_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0), F.col("target_share"))
    j = j.withColumn("share", there / F.sum(there).over(of_mix))
    j = j.withColumn("total", F.min(F.col("source_tokens") * F.col("max_repeats") / F.col("share")).over(of_mix))
    rate = F.when(F.col("share") > 0, F.least(F.col("share") * F.col("total") / F.col("source_tokens"), F.col("max_repeats").cast("double")))
    return j.withColumn("rate", F.coalesce(rate, F.lit(0.0)))


def mixed(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(copies(mix_id, source, doc_id, tokens, copies), rates)."""
    named = targets.select(F.lower(F.trim("source")).alias("source")).distinct()
    docs = documents.withColumn("source", F.lower(F.trim("source"))).join(named, "source", "left_semi")
    tokens = cut_lineage(token_counts(docs, tokenizer))
    totals = tokens.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("documents"))
    rate = cut_lineage(rates(targets, totals))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("documents") / CHUNK)).cast("long")
    rows = tokens.join(rate.filter("rate > 0").select("mix_id", "source", "rate", chunks.alias("chunks")), "source")
    rows = rows.withColumn("whole", F.floor(F.col("rate") + 1e-12)).withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    rows = rows.select("mix_id", "source", "doc_id", "tokens", "whole", "part", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("chunks")).alias("chunk"))
    many = rate.agg(F.max(chunks)).first()[0] or 1

    schema = "mix_id int, source string, doc_id bigint, tokens bigint, whole bigint, part double, chunk bigint, settled boolean"

    def level(at: int, last: bool):
        def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(["tokens", "doc_id"], ignore_index=True)
            rng = np.random.default_rng([seed, at, int(key[0]) & 0xFFFFFFFF, zlib.crc32(str(key[1]).encode()), int(key[2])])
            part, left = pivotal(g["part"].to_numpy(), rng)
            g["settled"] = True
            if last:
                part[left] = float(rng.random() < part[left])
            elif 0 < part[left] < 1:
                g.loc[left, "settled"] = False
            g["part"] = part
            g["chunk"] = g["chunk"] // FAN
            return g

        return run

    done, at = [], 0
    open_rows = rows
    while True:
        last = many <= 1
        out = cut_lineage(open_rows.groupBy("mix_id", "source", "chunk").applyInPandas(level(at, last), schema))
        done.append(out.filter("settled"))
        if last:
            break
        open_rows = out.filter("not settled").drop("settled")
        many, at = -(-many // FAN), at + 1
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    copies = (F.col("whole") + F.round("part").cast("bigint")).alias("copies")
    return every.select("mix_id", "source", "doc_id", "tokens", copies).filter("copies > 0"), rate


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixtures: each document's copies."""
    return _mixed(spark, sf_dir)[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each mixture and source: the target, what was reached, and the copies used."""
    copies, rate = _mixed(spark, sf_dir)
    reached = copies.groupBy("mix_id", "source").agg(F.count("*").alias("documents_used"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    j = rate.select("mix_id", "source", "target_share", "max_repeats").join(reached, ["mix_id", "source"], "left").fillna(0)
    return j.withColumn("reached_share", F.col("tokens") / F.greatest(F.lit(1), F.sum("tokens").over(W.partitionBy("mix_id"))))


QUERIES = {"p8_mix": p8_mix, "p8_report": p8_report}
SQL: dict[str, str] = {}

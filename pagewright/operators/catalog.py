"""The catalog of model providers as relations: models(provider, seq, id, api, url) and what is looked up in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The protocols that can be spoken to.
PROTOCOLS = ["openai-completions", "openai-responses", "anthropic-messages"]


def bare(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(url), "/+$", ""))


def providers(models: DataFrame) -> DataFrame:
    """Each provider's most frequent URL (of ties the first seen), its models, and how many can be used."""
    by_url = models.groupBy("provider", "url").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    top = by_url.groupBy("provider").agg(F.min(F.struct((-F.col("n")).alias("o"), "first", "url")).alias("t"))
    sums = models.groupBy("provider").agg(F.countDistinct("id").alias("models"), F.count_if(F.col("api").isin(PROTOCOLS)).alias("usable"))
    return sums.join(top.select("provider", F.col("t.url").alias("url")), "provider")


def detect(urls: DataFrame, models: DataFrame, defaults: DataFrame) -> DataFrame:
    """urls(key, url) -> the provider: one that has the URL for a model, else one whose default URL starts it or is started by
    it, each time the first in order; else `custom`. Exact look-ups are an equi-join; only what they leave is tried by prefix,
    on the URL's host, which two URLs of which one starts the other share."""
    u = urls.withColumn("u", bare(F.col("url")))
    exact = models.select(bare(F.col("url")).alias("u"), "place", "provider").groupBy("u").agg(F.min_by("provider", "place").alias("exact"))
    j = u.join(exact, "u", "left")
    host = lambda c: F.regexp_extract(c, r"^[a-z]*:?/*([^/:]*)", 1)
    d = defaults.select("place", F.col("provider").alias("p"), bare(F.col("url")).alias("base")).filter("base <> ''").withColumn("host", host("base"))
    near = j.filter("exact is null and u <> ''").select("key", "u").withColumn("host", host("u")).join(d, "host")
    near = near.filter(F.expr("startswith(u, base) or startswith(base, u)")).groupBy("key").agg(F.min_by("p", "place").alias("near"))
    return j.join(near, "key", "left").select("key", F.coalesce("exact", "near", F.lit("custom")).alias("provider"))


def ordered(providers: DataFrame, first: list[str]) -> DataFrame:
    """Providers in order: a given few first (`priority`), the rest by label."""
    place = F.array_position(F.array(*map(F.lit, first)), F.col("provider"))
    return providers.withColumn("priority", F.when(place > 0, place).otherwise(len(first) + 1)).orderBy("priority", "label", "provider")


def _roots(base: Column) -> tuple[Column, Column]:
    """The base without outer spaces and closing slashes; the same without what may have been pasted along: /v1, /v1/messages."""
    root = F.regexp_replace(F.trim(base), "/+$", "")
    return root, F.regexp_replace(F.regexp_replace(root, "/messages$", ""), "/v1$", "")


def endpoint(base: Column, protocol: Column) -> Column:
    root, bare_root = _roots(base)
    return F.when(protocol == "anthropic-messages", F.concat(bare_root, F.lit("/v1/messages"))).when(protocol == "openai-responses", F.concat(root, F.lit("/responses"))).otherwise(F.concat(root, F.lit("/chat/completions")))


def models_endpoint(base: Column, protocol: Column) -> Column:
    root, bare_root = _roots(base)
    return F.when(protocol == "anthropic-messages", F.concat(bare_root, F.lit("/v1/models"))).otherwise(F.concat(root, F.lit("/models")))

"""Settings, prompts, model requests and documents' inherited attributes, as relations and expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import is_blank, trim
from pagewright.session import cut_lineage

# What a prompt's template calls the language, and the language where none is set.
LANGUAGE_FIELD, DEFAULT_LANGUAGE = "{{target_language}}", "Simplified Chinese"


def inherited(objects: DataFrame, names: list[str]) -> DataFrame:
    """objects(id, parent, names..) -> each object's attributes, each from itself or the nearest ancestor that has it. Pointers
    are doubled: after k joins an object knows 2**k of its ancestors, so a tree of any depth takes the logarithm of its size in
    joins, and a circle of parents ends there too."""
    out = cut_lineage(objects.select("id", F.col("parent").alias("up"), *names))
    for _ in range(out.count().bit_length()):
        if out.filter("up is not null").isEmpty():
            break
        up = out.select(F.col("id").alias("up"), F.col("up").alias("next"), *(F.col(n).alias(f"up_{n}") for n in names))
        out = cut_lineage(out.join(up, "up", "left").select("id", F.col("next").alias("up"), *(F.coalesce(n, f"up_{n}").alias(n) for n in names)))
    return out.drop("up")


def page_frames(objects: DataFrame) -> DataFrame:
    """objects(id, parent, crop, media, rotate) -> (id, frame, rotation): the box a page is shown by, its own or that of the
    nearest ancestor with any (there the crop box first), and the nearest rotation other than 0, in [0, 360)."""
    o = objects.select("id", "parent", F.coalesce("crop", "media").alias("frame"), F.nullif(F.col("rotate"), F.lit(0)).alias("rotate"))
    return inherited(o, ["frame", "rotate"]).select("id", "frame", F.pmod(F.coalesce("rotate", F.lit(0)), F.lit(360)).alias("rotation"))


def prompt(template: Column, language: Column) -> Column:
    """The template with the language in its field, or at its end where the field was lost."""
    lang = F.when(is_blank(language), DEFAULT_LANGUAGE).otherwise(trim(language))
    return F.when(template.contains(LANGUAGE_FIELD), F.replace(template, F.lit(LANGUAGE_FIELD), lang)).otherwise(F.concat(template, F.lit("\n\nTarget language: "), lang))


def setting(user: Column, key: str, kind: str, default: Column) -> Column:
    """One value of a user's settings (JSON text) if it is there and of the right kind, else the default."""
    raw = F.get_json_object(user, f"$.{key}")
    fine = {"int": raw.try_cast("int").cast("string") == raw, "boolean": raw.isin("true", "false"), "string": raw.isNotNull()}[kind]
    return F.when(fine, raw.try_cast(kind)).otherwise(default)


def model_payload(enabled: Column, url: Column, key: Column, model: Column) -> Column:
    """What is sent along with a request: nothing if translation is on and a field is missing."""
    missing = is_blank(url) | is_blank(key) | is_blank(model)
    return F.when(~(enabled & missing), F.struct(enabled.alias("enabled"), trim(url).alias("base_url"), trim(key).alias("api_key"), trim(model).alias("model")))


def task_prompt(label: Column, prompts: dict[str, str]) -> Column:
    """The recognition prompt of a label, or the default one."""
    return F.coalesce(F.create_map(*map(F.lit, [x for p in prompts.items() for x in p]))[label], F.lit(prompts["_default"]))


def request_body(protocol: Column, model: Column, system: Column, user: Column, most_tokens: Column) -> Column:
    """The JSON body of one question in the protocol's shape."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    chat = F.to_json(F.struct(model.alias("model"), F.array(turn("system", system), turn("user", user)).alias("messages"), most_tokens.alias("max_tokens")))
    claude = F.to_json(F.struct(model.alias("model"), system.alias("system"), F.array(turn("user", user)).alias("messages"), most_tokens.alias("max_tokens")))
    responses = F.to_json(F.struct(model.alias("model"), system.alias("instructions"), F.array(turn("user", user)).alias("input"), most_tokens.alias("max_output_tokens")))
    return F.when(protocol == "anthropic-messages", claude).when(protocol == "openai-responses", responses).otherwise(chat)


def completion(protocol: Column, body: Column) -> Column:
    """The text of an answer in the protocol's shape."""
    return (
        F.when(protocol == "anthropic-messages", F.get_json_object(body, "$.content[0].text"))
        .when(protocol == "openai-responses", F.coalesce(F.get_json_object(body, "$.output_text"), F.get_json_object(body, "$.output[0].content[0].text")))
        .otherwise(F.get_json_object(body, "$.choices[0].message.content"))
    )


def reading_truncated(tokens: Column, has_end: Column, cap: Column) -> Column:
    return (tokens >= cap) & ~has_end


def torch_build(version: Column) -> Column:
    """What a library's version says it was built for."""
    suffix = F.regexp_extract(version, r"\+([a-z]+)", 1)
    return F.when(version.isNull(), "missing").when(suffix == "cu", "cuda").when(suffix == "cpu", "cpu").when(suffix == "rocm", "rocm").otherwise("default")


def satisfies(have: Column, want: Column) -> Column:
    """A build for CUDA also serves where one for the CPU is asked for."""
    return (have == want) | ((have == "cuda") & (want == "cpu"))


def models_missing(required: DataFrame, files: DataFrame, needed: list[str]) -> DataFrame:
    """required(model), files(model, name) -> the models that lack a needed file or have no weights."""
    have = files.groupBy("model").agg(F.collect_set("name").alias("names"), F.bool_or(F.col("name").endswith(".safetensors")).alias("weights"))
    complete = have.filter(F.forall(F.array(*map(F.lit, needed)), lambda n: F.array_contains("names", n)) & F.col("weights")).select("model")
    return required.join(complete, "model", "left_anti")

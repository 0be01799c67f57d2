"""Model registry: layered configurations, prompt references, request parts.

The registry is a handful of rows; configurations from files are read on the driver, everything else are expressions.  Keys
are never put into a DataFrame.
"""

from __future__ import annotations

import json
import os
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T

#: fixed values: request parameters that chat clients take as arguments; all others go into the body
CLIENT_PARAMETERS = (
    "model", "messages", "stream", "max_tokens", "temperature", "top_p", "n", "stop", "frequency_penalty", "presence_penalty",
    "logit_bias", "user", "response_format", "seed", "logprobs", "top_logprobs", "modalities", "tools", "tool_choice", "parallel_tool_calls",
)
FALLBACK_MODEL = "siliconflow_deepseek-ocr"


def read_toml(*paths: str) -> dict[str, dict]:
    """Sections ``defaults``, ``prompts``, ``meta`` and ``models`` of configuration files; later files override entry by entry."""
    sections: dict[str, dict] = {"defaults": {}, "prompts": {}, "meta": {}, "models": {}}
    for path in paths:
        with open(path, "rb") as f:
            data = tomllib.load(f)
        for name, entries in sections.items():
            entries.update(data.get(name, {}))
    sections["models"] = {k: v for k, v in sections["models"].items() if isinstance(v, dict)}
    return sections


def from_toml(spark: SparkSession, *paths: str) -> tuple[DataFrame, str]:
    """(registry rows, default model) of configuration files."""
    config = read_toml(*paths)
    rows = []
    for key, model in config["models"].items():
        rows.append((key, model.get("name", key), model.get("api_url"), model.get("model_id"), model.get("api_key_env"), model.get("batch_size", 1), model.get("timeout"),
                     {k: str(v) for k, v in model.get("headers", {}).items()}, json.dumps(model.get("payload_template", {})), model.get("content_format", "openai"),
                     resolve_prompt(model, config["prompts"], config["defaults"]), model.get("input_mode", "image")))
    schema = "model_key string, display_name string, api_url string, model_id string, api_key_env string, batch_size int, timeout_s int, headers map<string,string>, payload_template string, content_format string, prompt_text string, input_mode string"
    return spark.createDataFrame(rows, schema), os.environ.get("OCR_MODEL") or config["defaults"].get("default_model") or FALLBACK_MODEL


def meta_prompt(*paths: str) -> str | None:
    """The prompt for metadata of a book."""
    return read_toml(*paths)["meta"].get("prompt")


def resolve_prompt(model: dict, prompts: dict, defaults: dict) -> str | None:
    """Named prompt, inline prompt, default prompt, none; an empty or dangling name means none."""
    if "prompt_ref" in model:
        return prompts.get(model["prompt_ref"])
    if "prompt" in model:
        return model["prompt"]
    return prompts.get(defaults.get("default_prompt"))


def lookup(models: DataFrame, key: str | None, default: str) -> dict:
    """Configuration of a model by key, environment or default, with its key from the environment; unknown keys are an error.

    The registry is a handful of rows, of which one is read.
    """
    wanted = key or os.environ.get("OCR_MODEL") or default
    row = models.where(F.col("model_key") == wanted).first()
    if row is None:
        raise KeyError(f"no model {wanted!r}")
    config = row.asDict()
    name = (config.get("api_key_env") or "").strip()
    config["api_key"] = None if name.lower() in ("", "none", "no", "optional", "false") else os.environ.get(name)
    return config


def layered(builtin: DataFrame, external: DataFrame) -> DataFrame:
    """External rows replace built-in rows of the same key."""
    both = builtin.withColumn("_layer", F.lit(0)).unionByName(external.withColumn("_layer", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("model_key").orderBy(F.desc("_layer")))
    return both.withColumn("_n", first).where("_n = 1").drop("_n", "_layer")


def request_body(model_id: Column, template: Column, messages: Column) -> Column:
    """JSON body: model, messages, and the members of the template, which win.  ``messages`` and ``template`` are JSON."""
    named = lambda name, value: F.when(~F.array_contains(F.json_object_keys(template), name), F.concat(F.lit(f'"{name}":'), value))
    members = F.regexp_replace(template, r"\A\s*\{\s*|\s*\}\s*\z", "")
    quoted = F.regexp_replace(F.to_json(F.array(model_id)), r"\A\[|\]\z", "")
    return F.concat(F.lit("{"), F.concat_ws(",", named("model", quoted), named("messages", messages), F.nullif(members, F.lit(""))), F.lit("}"))


def split_parameters(template: Column) -> Column:
    """struct(arguments, body): template members by whether the client takes them as arguments."""
    members = F.from_json(template, "map<string,string>")
    known = lambda k: k.isin(*CLIENT_PARAMETERS)
    return F.struct(F.map_filter(members, lambda k, _: known(k)).alias("arguments"), F.map_filter(members, lambda k, _: ~known(k)).alias("body"))


def auth(df: DataFrame) -> DataFrame:
    """Adds whether a model needs a key and which headers it sends besides."""
    return df.withColumn("no_auth", T.needs_no_key(F.col("api_key_env"))).withColumn("n_headers", F.coalesce(F.size("headers"), F.lit(0)))


def base_url(api_url: Column) -> Column:
    return F.replace(api_url, F.lit("/chat/completions"), F.lit(""))

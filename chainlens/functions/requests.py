"""Batch request rows and their JSON answers as columns."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Method and address every batch request row carries.
_METHOD = "POST"
_ENDPOINT = "/v1/chat/completions"


def build_requests(
    df: DataFrame, custom_id: str, user_message: str, system_instruction: str, schema: Mapping, model: str,
    temperature: float | None = 0.0,
) -> DataFrame:
    """(custom_id, request): one JSON request per row; a null temperature leaves the field out.

    The answer schema is constant text, so it is placed into the JSON once instead of being built per row.
    """
    mark = "@schema@"
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_instruction).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col(user_message).alias("content")),
    )
    body = F.struct(
        F.lit(model).alias("model"), messages.alias("messages"),
        F.struct(F.lit("json_schema").alias("type"), F.lit(mark).alias("json_schema")).alias("response_format"),
        F.lit(temperature).cast("double").alias("temperature"),
    )
    row = F.to_json(F.struct(
        F.col(custom_id).cast("string").alias("custom_id"), F.lit(_METHOD).alias("method"), F.lit(_ENDPOINT).alias("url"),
        body.alias("body"),
    ))
    filled = F.replace(row, F.lit(f'"json_schema":"{mark}"'), F.lit('"json_schema":' + json.dumps(schema, separators=(",", ":"))))
    return df.select(F.col(custom_id).cast("string").alias("custom_id"), filled.alias("request"))


def parse_responses(df: DataFrame, key: str, response: str, field: str = "result") -> DataFrame:
    """(key, value) from JSON answers; null where the answer is no JSON or lacks the field."""
    return df.select(F.col(key), F.get_json_object(response, f"$.{field}").alias("value"))

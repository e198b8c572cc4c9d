"""Validation: a subset of JSON Schema for documents, and rules over tables."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "null": lambda v: v is None,
}


def problems(value: Any, schema: Any, root: Any = None, at: str = "") -> list[str]:
    """`/pointer: what is wrong` of a value by a schema, in the order of the document."""
    root = schema if root is None else root
    if schema is True or schema == {}:
        return []
    if schema is False:
        return [f"{at or '/'}: not allowed"]
    if "$ref" in schema:
        target = root
        for part in schema["$ref"].lstrip("#/").split("/"):
            target = target[part] if part else target
        return problems(value, target, root, at)
    found: list[str] = []
    say = lambda text: found.append(f"{at or '/'}: {text}")
    if "anyOf" in schema and all(problems(value, s, root, at) for s in schema["anyOf"]):
        say("fits none of the alternatives")
    if "const" in schema and (value != schema["const"] or type(value) is not type(schema["const"])):
        say(f"is not {json.dumps(schema['const'])}")
    if "enum" in schema and value not in schema["enum"]:
        say(f"is none of {json.dumps(schema['enum'])}")
    kinds = schema.get("type")
    if kinds and not any(KINDS[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        say(f"is not of type {kinds if isinstance(kinds, str) else ' or '.join(kinds)}")
        return found
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        say(f"does not match {schema['pattern']}")
    if KINDS["number"](value):
        for word, bad in (("minimum", lambda a, b: a < b), ("maximum", lambda a, b: a > b), ("exclusiveMinimum", lambda a, b: a <= b)):
            if word in schema and bad(value, schema[word]):
                say(f"breaks {word} {schema[word]}")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            say(f"has fewer than {schema['minItems']} items")
        if len(value) > schema.get("maxItems", len(value)):
            say(f"has more than {schema['maxItems']} items")
        first = schema.get("prefixItems", [])
        for i, item in enumerate(value):
            if i < len(first):
                found += problems(item, first[i], root, f"{at}/{i}")
            elif "items" in schema:
                found += problems(item, schema["items"], root, f"{at}/{i}")
    if isinstance(value, dict):
        for name in schema.get("required", []):
            if name not in value:
                say(f"lacks {name}")
        known = schema.get("properties", {})
        for name, item in value.items():
            if name in known:
                found += problems(item, known[name], root, f"{at}/{name}")
            elif "additionalProperties" in schema:
                found += problems(item, schema["additionalProperties"], root, f"{at}/{name}")
    return found


def violations(document: Column, schema: dict) -> Column:
    """The problems of JSON texts by a schema, as array<string>; a text that isn't JSON has one."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def check(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            try:
                return problems(json.loads(text or ""), schema)
            except ValueError:
                return ["/: is not JSON"]

        return pd.Series([one(t) for t in texts], index=texts.index)

    return check(document)


def unique(rows: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """(rule, key) of each key that more than one row has."""
    return rows.groupBy(*keys).count().filter("count > 1").select(F.lit(rule).alias("rule"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"))


def references(rows: DataFrame, column: str, target: DataFrame, key: str, rule: str) -> DataFrame:
    """(rule, key) of each value that the target lacks."""
    from lamella.operators.joins import foreign_keys

    return foreign_keys(rows, column, target, key).select(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("key")).distinct()


def broken(rows: DataFrame, condition: Column, key: str, rule: str) -> DataFrame:
    return rows.filter(condition).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def asserted(found: DataFrame, most: int = 10) -> None:
    """Raises with the first ten (rule, key) if there are any."""
    first = found.orderBy("rule", "key").limit(most).collect()
    if first:
        raise ValueError("; ".join(f"{r.rule}: {r.key}" for r in first))

"""Facet sources: tables, and JSON documents behind URLs fetched by tasks."""

import json
import urllib.request

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.compose import Source


def from_table(name: str, rows: DataFrame, key: str, value: Column, apply) -> Source:
    return Source(name, rows.select(key, value.alias("value")), apply)


def from_json(name: str, keys: DataFrame, key: str, url: Column, kind: str, apply, fetch=None, timeout: float = 10.0) -> Source:
    """One request per key, made by tasks; a failed request or an empty body leaves no row, which is a failed facet."""
    get = fetch or _fetch

    def run(batches):
        for b in batches:
            bodies = [get(u, timeout) for u in b["url"]]
            yield b.assign(body=bodies)[["key", "body"]]

    got = keys.select(F.col(key).alias("key"), url.alias("url")).mapInPandas(run, f"key {dict(keys.dtypes)[key]}, body string")
    value = F.from_json("body", kind)
    return Source(name, got.where("body is not null and body <> 'null'").select(F.col("key").alias(key), value.alias("value")), apply)


def _fetch(url: str, timeout: float) -> str | None:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            body = r.read().decode()
        json.loads(body)
        return body
    except (OSError, ValueError):
        return None

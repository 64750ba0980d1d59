"""Flat JSON objects as Markdown, inside Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flat_object(json: Column) -> Column:
    """A heading for each key, in order, with its value; null as (null); null for a text that is no object."""
    parsed = F.from_json(json, "map<string,string>")
    part = lambda e: F.concat(F.lit("## "), e["key"], F.lit("\n\n"), F.coalesce(e["value"], F.lit("(null)")))
    return F.array_join(F.transform(F.map_entries(parsed), part), "\n\n")

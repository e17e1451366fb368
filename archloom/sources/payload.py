"""Fact payloads: one JSON object with nodes, edges, evidence and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.functions.keys import lenient_int
from archloom.schema import PAYLOAD, PAYLOAD_SCHEMA

LENIENT = ("line_start", "line_end", "column_start", "column_end")


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four arrays of a payload file as frames with `position`, their place in the array."""
    return split(spark.read.schema(PAYLOAD_SCHEMA).json(path, multiLine=True))


def split(payload: DataFrame) -> dict[str, DataFrame]:
    out = {}
    for name in PAYLOAD:
        rows = payload.select(F.posexplode(name).alias("position", "r")).select("position", "r.*")
        out[name] = rows.withColumns({c: lenient_int(F.col(c)) for c in LENIENT}) if name == "evidence" else rows
    return out

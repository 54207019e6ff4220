"""The registered queries over the tables, and the SQL that each equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import containers, details, economic, graphs, ground, interval, mining, ordered, profiles, reports, reserves, routing, scalars, space, streams, terrain  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ENTRY", "ORACLE_SQL", "QUERIES"]


def ENTRY(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["reserve_totals"](spark, sf_dir)

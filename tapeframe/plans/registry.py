"""All registered queries over the driver tables, by area."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeframe.plans import arrivals, bars, context, health, ingest, microstructure, panel, planner, research, state, study, windows

AREAS = (bars, windows, state, context, planner, panel, arrivals, microstructure, research, study, ingest, health)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for area in AREAS for name, f in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in area.SQL.items()}

"""Registered queries: one per operator, each with its checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortframe.fixtures import Tables, with_views

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(key: str, check: str | None = None):
    def keep(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = fn
        if check is not None:
            CHECKS[key] = with_views(check)
        return fn
    return keep


def bound(key: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return QUERIES[key](Tables(spark, sf_dir))
    run.__name__ = key
    return run


def load() -> None:
    from cohortframe.catalog import (  # noqa: F401
        alignment, genetics, modelling, quality, reports, scalars, storage, synthetic)

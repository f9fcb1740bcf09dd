"""The queries over the driver's tables, by topic, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, archives, audits, corpus, evaluation, features, io, ladder, lattice, models, references

_TOPICS = (lattice, features, evaluation, ladder, alignment, corpus, audits, io, archives, models, references)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for topic in _TOPICS for name, f in topic.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for topic in _TOPICS for name, sql in topic.SQL.items()}

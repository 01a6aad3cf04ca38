"""The audits that can be run by name, each with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Audit = Callable[[SparkSession, str], DataFrame]

AUDITS: dict[str, Audit] = {}
ORACLES: dict[str, str] = {}


def audit(name: str, sql: str | None = None) -> Callable[[Audit], Audit]:
    def register(function: Audit) -> Audit:
        AUDITS[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register

"""Metadata filters: equality dictionaries, typed predicates that combine, and time ranges.

A key that the table has as a column of its own is compared as that column, so the scan gets
the filter; other keys are read from the metadata's JSON.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.json_text import metadata_value

_OPERATORS = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
Value = Callable[[str, object], Column]


def value_in(metadata: Column) -> Value:
    """Reads keys from metadata as JSON text."""
    return lambda key, like: metadata_value(metadata, key, like)


def value_of(table: DataFrame, metadata: str = "metadata") -> Value:
    """Reads a key from the table's column of that name, else from its metadata."""
    own, reserved = set(table.columns), {"id", metadata, "embedding", "contents"}
    return lambda key, like: F.col(key) if key in own - reserved else metadata_value(F.col(metadata), key, like)


class Predicate:
    """A comparison of a metadata key with a value, whose type decides the comparison; ``&`` and ``|`` combine."""

    def __init__(self, key: str, op: str, value: object):
        if op not in _OPERATORS:
            raise ValueError(f"unknown operator {op!r}")
        self._make: Callable[[Value], Column] = lambda of: _OPERATORS[op](of(key, value), F.lit(value))

    def on(self, of: Value) -> Column:
        return self._make(of)

    def column(self, metadata: Column) -> Column:
        return self.on(value_in(metadata))

    def _with(self, other: Predicate, join: Callable) -> Predicate:
        out = object.__new__(Predicate)
        out._make = lambda of: join(self.on(of), other.on(of))
        return out

    def __and__(self, other: Predicate) -> Predicate:
        return self._with(other, operator.and_)

    def __or__(self, other: Predicate) -> Predicate:
        return self._with(other, operator.or_)


def equality(of: Value, wanted: dict | list[dict]) -> Column:
    """All pairs of a dictionary; of a list of dictionaries any."""
    if isinstance(wanted, list):
        return reduce(operator.or_, (equality(of, w) for w in wanted), F.lit(False))
    return reduce(operator.and_, (of(k, v) == F.lit(v) for k, v in wanted.items()), F.lit(True))

"""The metadata filter language, compiled to one boolean Column.

A filter is {"must": [...], "should": [...], "must_not": [...]}; items are nested filters or conditions
{"key", "match": {"value" | "text"} | "range": {"gt", "gte", "lt", "lte"}}. Empty clauses don't count, so {} matches
all. should needs one match even beside must. A missing or null field matches nothing, and so passes must_not.
Without any of the three clauses a dict is the flat dialect: strings are numeric ranges ('>=10 & <100') or
substrings, other values exact; a second bound of the same direction replaces the first.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLAUSES, BOUNDS = ("must", "should", "must_not"), ("gt", "gte", "lt", "lte")
#: Numbers above this (the start of 2100 in seconds) are milliseconds. Fixed value.
MILLISECONDS_ABOVE = 4102444800
_OPS: dict[str, Callable] = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}
_SYMBOL = {">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}


def is_clause_dialect(spec: dict) -> bool:
    return any(k in spec for k in CLAUSES)


def numeric_range(text: str) -> dict | None:
    """Bounds of 'op number' or 'op number & op number', else None."""
    part = r"\s*(>=?|<=?)\s*(-?\d+(?:\.\d+)?)\s*"
    found = re.fullmatch(f"{part}(?:&{part})?", text)
    if not found:
        return None
    given = [x for x in found.groups() if x is not None]
    return {_SYMBOL[op]: float(number) for op, number in zip(given[::2], given[1::2])}


def from_flat(spec: dict) -> dict:
    def condition(key, value):
        if isinstance(value, str):
            bounds = numeric_range(value)
            return {"key": key, "range": bounds} if bounds else {"key": key, "match": {"text": value}}
        return {"key": key, "match": {"value": value}}

    return {"must": [condition(k, v) for k, v in spec.items()]}


def validate(spec: dict) -> None:
    for clause, items in spec.items():
        if clause not in CLAUSES:
            raise ValueError(f"unknown clause {clause!r}")
        for item in items:
            if is_clause_dialect(item):
                validate(item)
                continue
            match, bounds = item.get("match"), item.get("range")
            if not item.get("key") or (match is None) == (bounds is None):
                raise ValueError("a condition has a key and either match or range")
            if match is not None and len({"value", "text"} & set(match)) != 1:
                raise ValueError("match takes either value or text")
            if bounds is not None and not any(bounds.get(b) is not None for b in BOUNDS):
                raise ValueError("range needs a bound")


def moment(bound: str | float) -> float | None:
    """Epoch seconds of a range bound: ISO 8601 text (UTC unless it says otherwise), or a number of seconds or, where large, of milliseconds.
    None for text that is no date."""
    if not isinstance(bound, str):
        return bound / 1000 if bound > MILLISECONDS_ABOVE else float(bound)
    try:
        at = datetime.fromisoformat(bound) if bound.count("-") >= 2 else None
    except ValueError:
        at = None
    return at and (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp()


class Compiler:
    """Resolves keys against a schema: plain columns, or fields below `prefix`. Unknown keys are null."""

    def __init__(self, schema: T.StructType, prefix: str | None = None, clean: Callable[[str], str] | None = None):
        self.schema, self.prefix, self.clean = schema, prefix, clean or clean_needle

    def field(self, key: str) -> tuple[Column, T.DataType]:
        kind: T.DataType = self.schema
        path = ([self.prefix] if self.prefix else []) + key.split(".")
        for name in path:
            if not isinstance(kind, T.StructType) or name not in kind.names:
                return F.lit(None), T.NullType()
            kind = kind[name].dataType
        return F.col(".".join(f"`{p}`" for p in path)), kind

    def condition(self, item: dict) -> Column:
        column, kind = self.field(item["key"])
        if isinstance(kind, T.NullType):
            return F.lit(False)
        if "match" in item:
            if "text" in item["match"]:
                if not isinstance(kind, T.StringType):
                    return F.lit(False)
                return F.contains(F.lower(column), F.lit(self.clean(item["match"]["text"]).lower()))
            value = item["match"]["value"]
            same = isinstance(kind, T.BooleanType) if isinstance(value, bool) else isinstance(kind, T.NumericType) if isinstance(value, (int, float)) else isinstance(kind, T.StringType)
            return column == F.lit(value) if same else F.lit(False)
        bounds = {b: item["range"][b] for b in BOUNDS if item["range"].get(b) is not None}
        timed = isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
        if timed or any(isinstance(v, str) and moment(v) is not None for v in bounds.values()):
            at = F.unix_micros(column.cast("timestamp") if timed else F.try_to_timestamp(column)) / 1_000_000
            seconds = {b: moment(v) if moment(v) is not None else moment(float(v)) for b, v in bounds.items()}
            return reduce(Column.__and__, [_OPS[b](at, F.lit(v)) for b, v in seconds.items()])
        number = column.cast("double") if isinstance(kind, T.NumericType) else column.try_cast("double")
        return reduce(Column.__and__, [_OPS[b](number, F.lit(float(v))) for b, v in bounds.items()])

    def compile(self, spec: dict | None) -> Column:
        """A Column that is never null."""
        if not spec:
            return F.lit(True)
        if not is_clause_dialect(spec):
            spec = from_flat(spec)
        validate(spec)
        return self._filter(spec)

    def _filter(self, spec: dict) -> Column:
        item = lambda x: self._filter(x) if is_clause_dialect(x) else F.coalesce(self.condition(x), F.lit(False))
        parts = [item(x) for x in spec.get("must") or []]
        if spec.get("should"):
            parts.append(reduce(Column.__or__, [item(x) for x in spec["should"]]))
        parts += [~item(x) for x in spec.get("must_not") or []]
        return reduce(Column.__and__, parts) if parts else F.lit(True)


def clean_needle(text: str) -> str:
    """The needle cleaned as stored texts are (functions.text.clean), once, when the plan is made."""
    text = re.sub(r"https?://\S+", "", text)
    return re.sub(r"^(@[A-Za-z0-9_]+\s*)+", "", re.sub(r"\s+", " ", text).strip(" "))


def where(df: DataFrame, spec: dict | None, prefix: str | None = None) -> DataFrame:
    return df.where(Compiler(df.schema, prefix).compile(spec))


def cases(word: str, kind: tuple[str, object], number: tuple[str, float, float], flag: tuple[str, object], body: str) -> dict[str, dict | None]:
    """Seven filters by name that a search is tried with: none, one value, either of two, a range, an exclusion, words in a text, and all together."""
    one = {"key": kind[0], "match": {"value": kind[1]}}
    span = {"key": number[0], "range": {"gte": number[1], "lt": number[2]}}
    no = {"key": flag[0], "match": {"value": flag[1]}}
    says = {"key": body, "match": {"text": word}}
    return {"none": None, "value": {"must": [one]}, "either": {"should": [one, no]}, "range": {"must": [span]}, "exclusion": {"must_not": [no]}, "words": {"must": [says]}, "nested": {"must": [{"should": [one, says]}, span], "must_not": [no]}}

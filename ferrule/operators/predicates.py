"""Metadata predicates: a small dictionary language compiled to one Column, so that it is pushed into scans."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCLUDED = ("Black",)


def sanitise(where: dict[str, Any] | None) -> dict[str, Any]:
    """None values dropped; booleans and numbers kept; everything else as text."""
    return {str(k): v if isinstance(v, bool | int | float | list | dict) else str(v) for k, v in (where or {}).items() if v is not None}


def where(spec: dict[str, Any] | None, columns: list[str]) -> Column:
    """Equalities joined by AND; ``$and`` and ``$or`` take lists and stand alone; an absent key never equals a value."""
    spec = sanitise(spec)
    for op, join, empty in (("$and", lambda a, b: a & b, True), ("$or", lambda a, b: a | b, False)):
        if op in spec:
            return reduce(join, (where(x, columns) for x in spec[op]), F.lit(empty)) if spec[op] else F.lit(empty)
    if odd := [k for k in spec if k.startswith("$")]:
        raise ValueError(f"unsupported operator {odd[0]}")
    parts = [F.col(k).eqNullSafe(F.lit(v)) if k in columns else F.lit(False) for k, v in spec.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def apply_where(df: DataFrame, spec: dict[str, Any] | None) -> DataFrame:
    return df.where(where(spec, df.columns))


def without_tags(df: DataFrame, excluded: tuple[str, ...] = EXCLUDED, tag: str = "tag") -> DataFrame:
    """Rows whose tag isn't excluded; a blank tag counts as Green."""
    return df.where(~F.coalesce(F.nullif(F.trim(F.col(tag)), F.lit("")), F.lit("Green")).isin(*excluded)) if excluded else df

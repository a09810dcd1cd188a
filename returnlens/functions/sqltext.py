"""Spark SQL expression text and how to run a sequence of expressions.

The classification is a few hundred expressions. Written as SQL text they reach Catalyst in a
handful of parser calls; a table takes one column per name, compiled by code generation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count

from pyspark.sql import Column, DataFrame

Ref = Callable[[str], str]
# A stage maps a reference to what it adds (or replaces): name -> expression, as text or, for functions without a
# name, as columns.
Stage = Callable[[Ref], "dict[str, str | Column]"]

_names = count()


def text(value: str) -> str:
    """String literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_list(values: Iterable[str]) -> str:
    return ", ".join(text(v) for v in values)


def case(branches: Iterable[tuple[str, str]], otherwise: str | None = None) -> str:
    body = " ".join(f"WHEN {condition} THEN {value}" for condition, value in branches)
    return f"CASE {body}{'' if otherwise is None else f' ELSE {otherwise}'} END"


def any_of(conditions: Iterable[str]) -> str:
    return "(" + " OR ".join(conditions) + ")"


def contains_any(value: str, words: Iterable[str]) -> str:
    """Whether one of the literal words occurs; ``value`` should be a plain reference."""
    return any_of(f"contains({value}, {text(w)})" for w in words)


def each(array: str, body: Callable[[str, str], str]) -> str:
    """``transform`` with element and position."""
    item, index = f"x{next(_names)}", f"i{next(_names)}"
    return f"transform({array}, ({item}, {index}) -> {body(item, index)})"


def keep(array: str, condition: Callable[[str], str]) -> str:
    """``filter``."""
    item = f"x{next(_names)}"
    return f"filter({array}, {item} -> {condition(item)})"


def bind(value: str, body: Callable[[str], str]) -> str:
    """Evaluate a value once and use it several times."""
    item = f"x{next(_names)}"
    return f"get(transform(array({value}), {item} -> {body(item)}), 0)"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def run_on_table(df: DataFrame, stages: Iterable[Stage]) -> DataFrame:
    """One projection per stage over the columns of a table."""
    columns = [f"`{c}`" for c in df.columns]
    for stage in stages:
        added = stage(lambda name: f"`{name}`")
        columns = [c for c in columns if c.strip("`") not in added]
        if all(isinstance(value, str) for value in added.values()):
            df = df.selectExpr(*columns, *(f"{value} AS `{name}`" for name, value in added.items()))
        else:
            df = df.select(*columns, *(value.alias(name) for name, value in added.items()))
        columns += [f"`{name}`" for name in added]
    return df

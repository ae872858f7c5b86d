"""The filter mini-language: `column op value`, one clause a string.

Operators are == != >= <= > <, and is null, is not null, in, not in. The first
symbolic operator outside quotes wins, the longest at one place; keywords are
tried after symbols. Clauses become Column expressions, never SQL text.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import col
from ..functions.kinds import NUMERIC, kind_of

SYMBOLS = {"==": operator.eq, "!=": operator.ne, ">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt}
KEYWORDS = ("is not null", "is null", "not in", "in")


@dataclass(frozen=True)
class Clause:
    column: str
    op: str
    values: tuple[str, ...]


def _outside_quotes(text: str) -> list[bool]:
    """For each character, whether it stands outside quoted text; a doubled quote stays inside."""
    out, quote, i = [], "", 0
    while i < len(text):
        c = text[i]
        if quote:
            out.append(False)
            if c == quote:
                if text[i + 1 : i + 2] == quote:
                    out.append(False)
                    i += 1
                else:
                    quote = ""
        else:
            quote = c if c in "'\"" else ""
            out.append(not quote)
        i += 1
    return out


def _split_list(text: str) -> list[str]:
    free, parts, last = _outside_quotes(text), [], 0
    for i, c in enumerate(text):
        if c == "," and free[i]:
            parts.append(text[last:i])
            last = i + 1
    return [p.strip() for p in [*parts, text[last:]] if p.strip()]


def _unquote(text: str) -> str:
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1].replace(text[0] * 2, text[0])
    return text


def _cut(text: str) -> tuple[str, str, str] | None:
    """(left, operator, right) of a clause."""
    free = _outside_quotes(text)
    for i in range(len(text)):
        if free[i]:
            for op in sorted(SYMBOLS, key=len, reverse=True):
                if text.startswith(op, i):
                    return text[:i], op, text[i + len(op) :]
    for op in KEYWORDS:
        pattern = r"(?<=\s)" + op.replace(" ", r"\s+") + r"(?=\s|\(|$)"
        for m in re.finditer(pattern, text, re.I):
            if free[m.start()]:
                return text[: m.start()], op, text[m.end() :]
    return None


def parse_clause(text: str, schema: T.StructType) -> Clause:
    cut = _cut(text)
    if cut is None:
        raise ValueError(f"no operator in filter {text!r}; use one of {', '.join([*SYMBOLS, *KEYWORDS])}")
    name, op, right = _unquote(cut[0].strip()), cut[1], cut[2].strip()
    if name not in schema.names:
        raise ValueError(f"filter {text!r} names unknown column {name!r}; there are {', '.join(schema.names[:8])}")
    if op in ("is null", "is not null"):
        if right:
            raise ValueError(f"filter {text!r}: {op} takes no value")
        return Clause(name, op, ())
    if op in ("in", "not in"):
        if right.startswith("(") and right.endswith(")"):
            right = right[1:-1]
        values = tuple(_unquote(v) for v in _split_list(right))
        if not values:
            raise ValueError(f"filter {text!r}: the list is empty")
        return Clause(name, op, values)
    if not right:
        raise ValueError(f"filter {text!r}: a value is missing")
    return Clause(name, op, (_unquote(right),))


def _literal(value: str, field: T.StructField) -> Column:
    if kind_of(field.dataType) == NUMERIC:
        try:
            exact = Decimal(value)
        except InvalidOperation:
            return F.lit(value)
        if not exact.is_finite():
            return F.lit(float(value))
        if exact == exact.to_integral_value() and abs(exact) < 2**63:
            return F.lit(int(exact))
        return F.lit(exact) if isinstance(field.dataType, T.DecimalType) else F.lit(float(value))
    if isinstance(field.dataType, T.StringType):
        return F.lit(value)
    # A literal that isn't of the column's type is an error, not a filter that no row passes.
    wrong = F.raise_error(F.lit(f"filter on {field.name}: {value!r} is no {field.dataType.simpleString()}"))
    return F.coalesce(F.lit(value).try_cast(field.dataType), wrong)


def to_column(clause: Clause, schema: T.StructType) -> Column:
    field, c = schema[clause.column], col(clause.column)
    values = [_literal(v, field) for v in clause.values]
    if clause.op == "is null":
        return c.isNull()
    if clause.op == "is not null":
        return c.isNotNull()
    if clause.op in ("in", "not in"):
        found = c.isin(*values)
        return ~found if clause.op == "not in" else found
    return SYMBOLS[clause.op](c, values[0])


def parse_filter(text: str, schema: T.StructType) -> Column:
    """The predicate of one clause."""
    return to_column(parse_clause(text, schema), schema)


def to_sql(clause: Clause, schema: T.StructType, quote: str = '"') -> str:
    """The clause as SQL for a remote source that is read by query; values are quoted, never pasted."""
    name = quote + clause.column.replace(quote, quote * 2) + quote

    def literal(v: str) -> str:
        if kind_of(schema[clause.column].dataType) == NUMERIC and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v):
            return v
        return "'" + v.replace("'", "''") + "'"

    if not clause.values:
        return f"{name} {clause.op.upper()}"
    if clause.op in ("in", "not in"):
        return f"{name} {clause.op.upper()} ({', '.join(map(literal, clause.values))})"
    return f"{name} {({'==': '=', '!=': '<>'}).get(clause.op, clause.op)} {literal(clause.values[0])}"

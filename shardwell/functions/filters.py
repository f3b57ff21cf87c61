"""Filter expressions `COLUMN OP VALUE` as Spark predicates."""

from __future__ import annotations

import datetime as dt
import operator
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import is_datetime, is_numeric, is_time, quoted

# Longer operators first, so that ">=" is not read as ">".
OPERATORS = {"==": operator.eq, "!=": operator.ne, ">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt}
USAGE = "use COLUMN OP VALUE with OP one of ==, !=, >=, <=, >, <; put a column name that holds such characters in [brackets]"


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Expression:
    column: str
    op: str
    value: str


def parse(text: str) -> Expression:
    """Split at the first operator outside brackets. Both sides must be there; brackets must close before it, and
    stand around the whole column name if at all. A name may hold none of = < > ! unless bracketed."""

    def wrong(why: str) -> FilterError:
        return FilterError(f"Invalid --filter expression {text!r}: {why}; {USAGE}")

    depth = 0
    for i, c in enumerate(text):
        depth += (c == "[") - (c == "]")
        if depth < 0:
            raise wrong("a bracket closes that was not opened")
        op = next((o for o in OPERATORS if text.startswith(o, i)), None) if not depth else None
        if op:
            break
    else:
        raise wrong("no operator")
    name, value = text[:i].strip(), text[i + len(op) :].strip()
    if name.startswith("[") and name.endswith("]"):
        name = name[1:-1].strip()
    elif "[" in name or "]" in name:
        raise wrong("brackets stand around the whole column name or nowhere")
    elif any(c in name for c in "=<>!"):
        raise wrong("the column name holds an operator character")
    if not name:
        raise wrong("no column")
    if not value:
        raise wrong("no value")
    return Expression(name, op, value)


def _unquoted(text: str) -> str:
    return text[1:-1] if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'" else text


def literal(text: str, kind: T.DataType) -> Column:
    """The value as a literal of the column's type; FilterError if it is none."""
    plain = _unquoted(text)
    try:
        if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
            return F.lit(plain)
        if isinstance(kind, T.DateType):
            return F.lit(dt.date.fromisoformat(plain))
        if is_time(kind):
            time = dt.time.fromisoformat(plain)
            if time.tzinfo is not None:
                raise ValueError("a time column takes no offset")
            return F.lit(time.isoformat()).cast(kind)
        if is_datetime(kind):
            moment = dt.datetime.fromisoformat(plain)
            if isinstance(kind, T.TimestampNTZType):
                naive = moment.astimezone(dt.timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment
                return F.lit(naive.isoformat(sep=" ")).cast("timestamp_ntz")
            return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ltz")  # a naive literal is in the session's zone
        if isinstance(kind, T.BooleanType):
            if plain.lower() not in ("true", "false"):
                raise ValueError("a boolean is true or false")
            return F.lit(plain.lower() == "true")
        if isinstance(kind, T.DecimalType):
            return F.lit(Decimal(plain))
        if is_numeric(kind):
            return F.lit(_number(plain))
    except (ValueError, InvalidOperation) as e:
        raise FilterError(f"Invalid --filter value {text!r} for a {kind.simpleString()} column: {e}") from None
    if plain.lower() in ("true", "false"):
        return F.lit(plain.lower() == "true")
    try:
        return F.lit(_number(plain))
    except ValueError:
        return F.lit(plain)


def _number(text: str) -> int | float:
    try:
        return int(text)
    except ValueError:
        return float(text)


def predicate(expression: Expression | str, schema: T.StructType) -> Column:
    """The predicate on a frame of this schema. A null cell satisfies no comparison."""
    e = parse(expression) if isinstance(expression, str) else expression
    kinds = {f.name: f.dataType for f in schema.fields}
    if e.column not in kinds:
        raise FilterError(f"Column not found for --filter: {e.column}")
    return OPERATORS[e.op](quoted(e.column), literal(e.value, kinds[e.column]))

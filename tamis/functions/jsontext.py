"""JSON values as text: keys in order, numbers in their shortest form, compact or with two blanks a level."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions.text import number_words

#: Nesting that a document may have.
DEEPEST = 127


class NotJson(ValueError):
    """Text that is no JSON value, or a value that JSON cannot hold."""


def _refuse(token: str):
    raise NotJson(token)


def _whole(token: str) -> int | float:
    n = int(token)
    if -(2**63) <= n < 2**64:
        return n
    return _fraction(token)


def _fraction(token: str) -> float:
    x = float(token)
    if not math.isfinite(x):
        raise NotJson(token)
    return x


decoder = json.JSONDecoder(parse_constant=_refuse, parse_int=_whole, parse_float=_fraction)


def loads(text: str) -> object:
    """The one value of a text; anything else is NotJson."""
    try:
        value, end = decoder.raw_decode(text, _blank(text, 0))
    except (ValueError, RecursionError) as e:
        raise NotJson(str(e)) from None
    if _blank(text, end) != len(text):
        raise NotJson("trailing characters")
    return checked(value)


def _blank(text: str, at: int) -> int:
    while at < len(text) and text[at] in " \t\n\r":
        at += 1
    return at


def stream(text: str) -> list[tuple[object, str]]:
    """The values of a text one after another, each with its own text; NotJson if one is broken."""
    found, at = [], _blank(text, 0)
    while at < len(text):
        try:
            value, end = decoder.raw_decode(text, at)
        except (ValueError, RecursionError) as e:
            raise NotJson(str(e)) from None
        # Numbers and words need a blank before the next value; strings, arrays and objects do not.
        if end < len(text) and text[end] not in " \t\n\r[]{}\",:" and not isinstance(value, (str, list, dict)):
            raise NotJson("trailing characters")
        found.append((checked(value), text[at:end]))
        at = _blank(text, end)
    return found


def checked(value: object, depth: int = 0) -> object:
    """The value, if its nesting and its texts are those of JSON."""
    if depth > DEEPEST:
        raise NotJson("nested too deep")
    if isinstance(value, str):
        try:
            value.encode()
        except UnicodeEncodeError:
            raise NotJson("lone surrogate") from None
    elif isinstance(value, list):
        for x in value:
            checked(x, depth + 1)
    elif isinstance(value, dict):
        for k, x in value.items():
            checked(k)
            checked(x, depth + 1)
    return value


def dumps(value: object, indent: int | None = None, level: int = 0) -> str:
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return number_words(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    gap = "" if indent is None else "\n" + " " * indent * (level + 1)
    end = "" if indent is None else "\n" + " " * indent * level
    if isinstance(value, dict):
        colon = ":" if indent is None else ": "
        parts = [f"{gap}{json.dumps(k, ensure_ascii=False)}{colon}{dumps(value[k], indent, level + 1)}" for k in sorted(value)]
        return f"{{{','.join(parts)}{end}}}" if parts else "{}"
    parts = [gap + dumps(x, indent, level + 1) for x in value]
    return f"[{','.join(parts)}{end}]" if parts else "[]"


def pretty(json_text: Column) -> Column:
    """JSON text with two blanks a level; only for arrays and objects that a selector shows."""
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else dumps(loads(x), 2))

    return F.pandas_udf(run, "string")(json_text)

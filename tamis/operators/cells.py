"""A value that a path leads to, as columns for each kind it can be, and the operators on it.

A kind that the plan rules out is the Python value False, so that expressions fold here and what is left for
Catalyst is small. A missing value is none of the kinds, and no operator but ``not`` holds for it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions import text as texts
from tamis.functions.regex import search
from tamis.plans.ast import Boolean, Null, Number, Path, Regex, Text, Value

Bool = Column | bool


def both(*parts: Bool) -> Bool:
    out: Bool = True
    for p in parts:
        if p is False:
            return False
        if p is not True:
            out = p if out is True else out & p
    return out


def either(*parts: Bool) -> Bool:
    out: Bool = False
    for p in parts:
        if p is True:
            return True
        if p is not False:
            out = p if out is False else out | p
    return out


def negated(p: Bool) -> Bool:
    return (not p) if isinstance(p, bool) else ~F.coalesce(p, F.lit(False))


def column(p: Bool) -> Column:
    return F.lit(p) if isinstance(p, bool) else p


@dataclass(frozen=True)
class Cell:
    """is_*: whether the value is of that kind; the columns beside them hold where it is."""

    present: Bool = False
    is_null: Bool = False
    is_text: Bool = False
    text: Column | None = None
    is_number: Bool = False
    number: Column | None = None
    shown_number: Column | None = None
    is_bool: Bool = False
    boolean: Column | None = None
    is_many: Bool = False  # arrays and objects
    json: Column | None = None  # compact
    filled: Column | None = None  # whether they hold anything
    pretty: Column | None = None
    #: A text column that is null exactly where the value is null, and nothing else: comparisons may push down.
    plain: bool = field(default=False)

    def shown(self, pretty: bool = False) -> Column:
        """Text form of a present value; null where it is missing."""
        if self.present is False:
            return F.lit(None).cast("string")
        composite = self.pretty if pretty else self.json
        kinds = [(self.is_text, self.text), (self.is_number, self.shown_number), (self.is_bool, None if self.boolean is None else self.boolean.cast("string")), (self.is_many, composite), (self.is_null, F.lit("null"))]
        kinds = [(k, v) for k, v in kinds if k is not False]
        out = None
        for k, v in reversed(kinds):
            if k is True:
                out = v
            else:
                out = F.when(k, v) if out is None else F.when(k, v).otherwise(out)
        shown = out if out is not None else F.lit(None).cast("string")
        return shown if self.present is True else F.when(self.present, shown)

    def truthy(self) -> Bool:
        return both(self.present, either(
            both(self.is_bool, self.boolean) if self.is_bool is not False else False,
            both(self.is_text, _true_text(self.text)) if self.is_text is not False else False,
            both(self.is_number, self.number != 0) if self.is_number is not False else False,
            both(self.is_many, self.filled) if self.is_many is not False else False,
        ))


def _true_text(s: Column) -> Column:
    low = F.lower(s)
    # Texts that stand for false. Those that stand for true are not empty, as any other true text.
    return ~low.isin("false", "f", "0", "no", "off") & (s != "")


def near(a: Column, b: Column | float) -> Column:
    """Equal numbers: within EPSILON; infinities and NaN equal nothing."""
    return F.abs(a - b) < texts.EPSILON


def compare(cell: Cell, op: str, value: Value, other: Cell | None = None) -> Bool:
    """Whether the operator holds, true or else false or null. other: the cell that a path on the right leads to."""
    if isinstance(value, Path):
        if other is None or other.present is False:
            return False
        return both(other.present, _against_cell(cell, op, other))
    if op in ("==", "!="):
        same = both(cell.present, equal(cell, value))
        return same if op == "==" else both(cell.present, negated(same))
    if op in ("<", "<=", ">", ">="):
        number = value.value if isinstance(value, Number) else texts.parse_number(value.value) if isinstance(value, Text) else None
        if number is None or number != number:
            return False
        return both(cell.present, either(*(both(kind, _ordered(x, op, F.lit(number))) for kind, x in _numbers(cell))))
    if op == "~=":
        if not isinstance(value, (Regex, Text)):
            return False
        return both(cell.present, matches(cell.shown(), value))
    if not isinstance(value, Text):
        return False
    return both(cell.present, _text_test(cell, op, value.value))


def _numbers(cell: Cell) -> list[tuple[Bool, Column]]:
    """The kinds that read as numbers, with their numbers (null where a text does not)."""
    found = []
    if cell.is_number is not False:
        found.append((cell.is_number, cell.number))
    if cell.is_text is not False:
        found.append((cell.is_text, texts.parsed(cell.text)))
    return found


def _ordered(x: Column, op: str, y: Column) -> Column:
    held = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return held & ~F.isnan(x)


def equal(cell: Cell, value: Value) -> Bool:
    if isinstance(value, Null):
        return cell.is_null
    if isinstance(value, Boolean):
        return both(cell.is_bool, cell.boolean == value.value) if cell.is_bool is not False else False
    if isinstance(value, Number):
        composite = both(cell.is_many, near(texts.parsed(cell.json), value.value)) if cell.is_many is not False else False
        return either(*(both(k, near(x, value.value)) for k, x in _numbers(cell)), composite)
    if isinstance(value, Text):
        number = texts.parse_number(value.value)
        return either(
            both(cell.is_text, cell.text == value.value) if cell.is_text is not False else False,
            both(cell.is_number, near(cell.number, number)) if cell.is_number is not False and number is not None else False,
            both(cell.is_many, cell.json == value.value) if cell.is_many is not False else False,
        )
    return False


def _text_test(cell: Cell, op: str, s: str) -> Bool:
    test = {"*=": lambda c: c.contains(s), "~": lambda c: c.contains(s), "^=": lambda c: c.startswith(s), "$=": lambda c: c.endswith(s)}[op]
    if cell.plain:
        null = {"*=": s in "null", "~": s in "null", "^=": "null".startswith(s), "$=": "null".endswith(s)}[op]
        return either(test(cell.text), both(cell.is_null, null))
    return test(cell.shown())


def matches(shown: Column, value: Regex | Text) -> Column:
    how = search(value.pattern, value.flags) if isinstance(value, Regex) else search(value.value)
    if how.java is not None:
        return shown.rlike(how.java)
    return F.contains(F.lower(shown), F.lit(how.plain.lower())) if how.fold else F.contains(shown, F.lit(how.plain))


def _against_cell(a: Cell, op: str, b: Cell) -> Bool:
    """Both sides are fields. Arrays and objects on the right count as their compact text."""
    right_text = either(b.is_text, b.is_many)
    words = None
    if right_text is not False:
        words = b.text if b.is_many is False else b.json if b.is_text is False else F.when(column(b.is_text), b.text).otherwise(b.json)
    if op in ("==", "!="):
        same: list[Bool] = [both(a.is_null, b.is_null)]
        if a.is_bool is not False and b.is_bool is not False:
            same.append(both(a.is_bool, b.is_bool, a.boolean == b.boolean))
        if words is not None:
            if a.is_text is not False:
                same.append(both(a.is_text, right_text, a.text == words))
            if a.is_many is not False:
                same.append(both(a.is_many, right_text, a.json == words))
            if a.is_number is not False:
                same.append(both(a.is_number, right_text, near(a.number, texts.parsed(words))))
        if b.is_number is not False:
            same += [both(k, b.is_number, near(x, b.number)) for k, x in _numbers(a)]
        held = both(a.present, either(*same))
        return held if op == "==" else both(a.present, negated(held))
    if op in ("<", "<=", ">", ">="):
        rights = ([(b.is_number, b.number)] if b.is_number is not False else []) + ([(right_text, texts.parsed(words))] if words is not None else [])
        return both(a.present, either(*(both(k, j, _ordered(x, op, y), ~F.isnan(y)) for k, x in _numbers(a) for j, y in rights)))
    if words is None:
        return False
    shown = a.shown()
    if op == "~=":
        return both(a.present, right_text, _row_regex(shown, words))
    test = {"*=": F.contains, "~": F.contains, "^=": F.startswith, "$=": F.endswith}[op](shown, words)
    return both(a.present, right_text, test)


def _row_regex(shown: Column, pattern: Column) -> Column:
    """A pattern of each row's own: translated in Arrow batches, once for each pattern of a batch, and run by the JVM; what is no pattern is contained or not."""

    def run(patterns: pd.Series) -> pd.Series:
        from tamis.functions.regex import of_row

        return patterns.map({p: of_row(p) for p in patterns.dropna().unique()})

    java = F.pandas_udf(run, "string")(pattern)
    return F.when(java.isNotNull(), F.rlike(shown, java)).otherwise(F.contains(shown, pattern))

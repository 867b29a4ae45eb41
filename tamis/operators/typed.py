"""Queries on tables with a schema, as columns that push down.

A path is resolved against the schema when the plan is made. A NULL cell is a JSON null; a column that the schema
lacks is missing. At positive polarity a predicate may be NULL where it does not hold, so plain comparisons reach
the scan; ``not`` goes down to the leaves for the same reason.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions import text as texts
from tamis.functions.jsontext import pretty
from tamis.operators.binding import Binding
from tamis.operators.cells import Bool, Cell, both, either, negated
from tamis.plans.ast import Compare, Null, Number, Path, Query, Text

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)


def canonical(c: Column, kind: T.DataType) -> Column:
    """The value with the fields of its objects in order of name, as JSON text shows them."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*[canonical(c.getField(f.name), f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(c, lambda x: canonical(x, kind.elementType))
    return c


def to_json(c: Column, kind: T.DataType) -> Column:
    return F.to_json(canonical(c, kind), {"ignoreNullFields": "false"})


def cell_of(c: Column, kind: T.DataType, inside: Bool = True) -> Cell:
    """The cell of a column of one type; inside: whether what holds the column is there."""
    null, there = c.isNull(), c.isNotNull()
    if isinstance(kind, T.NullType):
        return Cell(present=inside, is_null=True)
    base = {"present": inside, "is_null": null}
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return Cell(**base, is_text=there, text=c, plain=inside is True)
    if isinstance(kind, _WHOLE):
        return Cell(**base, is_number=there, number=c.cast("double"), shown_number=c.cast("string"))
    if isinstance(kind, (*_FLOATS, T.DecimalType)):
        x = c.cast("double")
        return Cell(**base, is_number=there, number=x, shown_number=texts.number_text(x))
    if isinstance(kind, T.BooleanType):
        return Cell(**base, is_bool=there, boolean=c)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        json = to_json(c, kind)
        filled = F.size(c) > 0 if not isinstance(kind, T.StructType) else F.lit(bool(kind.fields))
        return Cell(**base, is_many=there, json=json, filled=filled, pretty=pretty(json))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        zone = "XXX" if isinstance(kind, T.TimestampType) else ""
        return Cell(**base, is_text=there, text=F.date_format(c, f"yyyy-MM-dd'T'HH:mm:ss.SSSSSS{zone}"), plain=inside is True)
    return Cell(**base, is_text=there, text=c.cast("string"), plain=inside is True)


class Typed(Binding):
    """Cells and predicates of one table with a schema."""

    def __init__(self, df: DataFrame):
        self.fields = {f.name: f.dataType for f in df.schema.fields}

    def find(self, path: Path) -> tuple[Column, T.DataType, Bool] | None:
        first = path.parts[0]
        if first not in self.fields:
            if path.is_original:
                return to_json(F.struct(*[F.col(f"`{n}`") for n in self.fields]), T.StructType([T.StructField(n, t) for n, t in self.fields.items()])), T.StringType(), True
            return None
        c, kind, inside = F.col(f"`{first}`"), self.fields[first], True
        for part in path.parts[1:]:
            holder = c
            if isinstance(kind, T.StructType):
                found = next((f for f in kind.fields if f.name == part), None)
                if found is None:
                    return None
                c, kind, inside = c.getField(part), found.dataType, both(inside, holder.isNotNull())
            elif isinstance(kind, T.ArrayType):
                if not part.isascii() or not part.isdigit() or int(part) > 2**31 - 2:
                    return None
                c, kind, inside = F.get(c, F.lit(int(part))), kind.elementType, both(inside, F.size(holder) > int(part))
            elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
                c, kind, inside = F.try_element_at(c, F.lit(part)), kind.valueType, both(inside, F.coalesce(F.map_contains_key(holder, part), F.lit(False)))
            else:
                return None
        return c, kind, inside

    def cell(self, path: Path) -> Cell:
        found = self.find(path)
        return Cell() if found is None else cell_of(*found)

    def leaf(self, f: Compare) -> Bool:
        sharp = self.sharp(f)
        return super().leaf(f) if sharp is None else sharp

    def leaf_fails(self, f: Compare) -> Bool:
        if (found := self.find(f.path)) is not None and found[2] is True:
            c, kind, _ = found
            if isinstance(f.value, Number) and isinstance(kind, (*_WHOLE, *_FLOATS)) and f.op in _OPPOSITE:
                opposite = Compare(f.path, _OPPOSITE[f.op], f.value)
                return either(c.isNull(), self.sharp(opposite), F.isnan(c) if isinstance(kind, _FLOATS) else False)
            if f.op in ("==", "!=") and not isinstance(f.value, Path):
                # Either holds only where the field is there, and one of them does then.
                return self.leaf(Compare(f.path, "!=" if f.op == "==" else "==", f.value))
        return negated(self.leaf(f))

    def sharp(self, f: Compare) -> Bool | None:
        """A comparison of a top-level column with a literal in the form that scans take, or None for the general way."""
        found = self.find(f.path)
        if found is None:
            return False
        c, kind, inside = found
        if f.op == "!=":
            if isinstance(f.value, Path) or inside is not True:
                return None
            if isinstance(f.value, Null):
                return c.isNotNull()
            same = self.sharp(Compare(f.path, "==", f.value))
            if same is None:
                return None
            if same is False:
                return True
            if isinstance(kind, T.StringType) and isinstance(f.value, Text):
                return c.isNull() | (c != f.value.value)
            return either(c.isNull(), ~same)
        if f.op == "==" and isinstance(f.value, Null):
            return both(inside, c.isNull())
        if isinstance(kind, T.StringType) and f.op == "==" and isinstance(f.value, Text):
            return both(inside, c == f.value.value)
        b = f.value.value if isinstance(f.value, Number) else texts.parse_number(f.value.value) if isinstance(f.value, Text) else None
        if not isinstance(f.value, (Number, Text)) or f.op not in ("==", "<", "<=", ">", ">=") or not isinstance(kind, (*_WHOLE, *_FLOATS)):
            return None
        if b is None or b != b:
            return False
        if isinstance(kind, _WHOLE):
            return both(inside, _whole(c, f.op, b, kind))
        if f.op == "==":
            if math.isinf(b):
                return False
            if abs(b) > 1:
                return both(inside, c == F.lit(b))
            return both(inside, c.between(b - texts.EPSILON, b + texts.EPSILON), F.abs(c - b) < texts.EPSILON)
        held = {"<": c < b, "<=": c <= b, ">": c > b, ">=": c >= b}[f.op]
        return both(inside, held, ~F.isnan(c)) if f.op in (">", ">=") else both(inside, held)


_OPPOSITE = {"<": ">=", "<=": ">", ">": "<=", ">=": "<"}


def _whole(c: Column, op: str, b: float, kind: T.DataType) -> Bool:
    """A column of whole numbers against any number, with a literal of the column's type."""
    bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}[type(kind)]
    least, most = -(2 ** (bits - 1)), 2 ** (bits - 1) - 1
    if op == "==":
        return c == F.lit(int(b)).cast(kind) if math.isfinite(b) and b == int(b) and least <= b <= most else False
    if b > most:
        return c.isNotNull() if op in ("<", "<=") else False
    if b < least:
        return c.isNotNull() if op in (">", ">=") else False
    low, high = F.lit(math.floor(b)).cast(kind), F.lit(math.ceil(b)).cast(kind)
    return {"<": c < high, "<=": c <= low, ">": c > low, ">=": c >= high}[op]


def where(df: DataFrame, query: Query) -> DataFrame:
    """The rows of a table that pass the query's filter, with all their columns."""
    return Typed(df).where(df, query)


def select(df: DataFrame, query: Query, name: str = "value") -> DataFrame:
    """One text column: what the query prints for each row. A selector prints nothing where the field is missing."""
    return Typed(df).select(df, query, name)

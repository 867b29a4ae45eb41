"""Queries on records without a schema.

``Json`` reads a VARIANT column and its JSON text; ``Words``, ``Fields`` and ``Pairs`` read the arrays and maps that lines of
text, CSV and logfmt split into, without a detour over JSON.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import text as texts
from tamis.functions.jsontext import dumps, loads, pretty
from tamis.operators.binding import Binding, paths
from tamis.operators.cells import Cell
from tamis.plans.ast import Path, Query
from tamis.sources.detect import BLANKS

#: Words that are read off a line one by one.
NEAR = 32
#: Keys that a VARIANT path can name.
_NAMED = re.compile(r"[^'\"?\[\]\\]+")


def _original(raw: Column) -> Cell:
    return Cell(present=raw.isNotNull(), is_text=True, text=raw)


def _index(part: str) -> int | None:
    digits = part[1:] if part.startswith("+") else part
    return int(digits) if digits.isascii() and digits.isdigit() and int(digits) < 2**31 - 1 else None


class Json(Binding):
    """rec: VARIANT; doc: the same as JSON text, which keeps numbers as they were written; raw: the original text, null for values that are no objects."""

    def __init__(self, rec: Column, doc: Column, raw: Column, known: dict[Path, int] | None = None):
        self.rec, self.doc, self.raw, self.known = rec, doc, raw, known or {}

    def prepared(self, df: DataFrame, query: Query) -> tuple[DataFrame, Json]:
        """Each path is followed once: its value and its JSON text become columns."""
        known = {p: i for i, p in enumerate(p for p in paths(query) if not p.is_original)}
        if not known:
            return df, self
        followed = {i: self.followed(p) for p, i in known.items()}
        found = df.withColumns({f"_v{i}": v for i, (v, _) in followed.items()})
        found = found.withColumns({f"_k{i}": F.schema_of_variant(F.col(f"_v{i}")) for i in followed})
        # Only numbers, arrays and objects are shown by their JSON text.
        found = found.withColumns({f"_j{i}": F.when(~F.col(f"_k{i}").isin("STRING", "BOOLEAN", "VOID"), j) for i, (_, j) in followed.items()})
        return found, Json(self.rec, self.doc, self.raw, known)

    def followed(self, path: Path) -> tuple[Column, Column]:
        if all(_NAMED.fullmatch(p) for p in path.parts):
            v, json = self.rec, None
            steps = [""]
            for part in path.parts:
                at = _index(part)
                inner = F.try_variant_get(v, f"$['{part}']", "variant")
                if at is None:
                    steps = [f"{s}['{part}']" for s in steps]
                    v = inner
                else:
                    v = F.coalesce(F.try_variant_get(v, f"$[{at}]", "variant"), inner)
                    steps = [f"{s}{p}" for s in steps for p in (f"[{at}]", f"['{part}']")]
            json = F.coalesce(*[F.get_json_object(self.doc, f"${s}") for s in steps]) if len(steps) > 1 else F.get_json_object(self.doc, f"${steps[0]}")
        else:
            json = _fragment(self.doc, path.parts)
            v = F.try_parse_json(json)
        return v, json

    def cell(self, path: Path) -> Cell:
        if path.is_original:
            return _original(self.raw)
        if path in self.known:
            v, json, kind = (F.col(f"_{c}{self.known[path]}") for c in "vjk")
        else:
            v, json = self.followed(path)
            kind = F.schema_of_variant(v)
        number = F.try_variant_get(v, "$", "double")
        many = F.coalesce(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit(False))
        whole = F.regexp_replace(json, "^-0$", "0")
        composite = F.when(many, json)
        return Cell(
            present=v.isNotNull(), is_null=kind == "VOID", is_text=kind == "STRING", text=F.try_variant_get(v, "$", "string"), is_bool=kind == "BOOLEAN", boolean=F.try_variant_get(v, "$", "boolean"),
            is_number=kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), number=number,
            shown_number=F.when(json.rlike("^-?[0-9]{1,18}\\z") | (json.rlike("^-?[0-9]{19,20}\\z") & number.between(-(2.0**63), 2.0**64 - 2048)), whole).otherwise(texts.number_text(number)),
            is_many=many, json=composite, filled=~json.isin("[]", "{}"), pretty=pretty(composite),
        )


def _fragment(doc: Column, parts: tuple[str, ...]) -> Column:
    """The JSON text that a path leads to, for keys that no VARIANT path can name."""
    def run(s: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            value = loads(text)
            for part in parts:
                if isinstance(value, dict) and part in value:
                    value = value[part]
                elif isinstance(value, list) and (at := _index(part)) is not None and at < len(value):
                    value = value[at]
                else:
                    return None
            return dumps(value)

        return s.map(one)

    return F.pandas_udf(run, "string")(doc)


class Words(Binding):
    """Lines split into an array of texts, called prefix_0, prefix_1, ..., and all of them _array."""

    prefix = "word"

    def __init__(self, parts: Column, raw: Column):
        self.parts, self.raw = parts, raw

    def at(self, i: int) -> Column:
        return F.get(self.parts, F.lit(i))

    def cell(self, path: Path) -> Cell:
        if path.is_original:
            return _original(self.raw)
        if path.parts == ("_array",):
            json = F.to_json(self.parts)
            return Cell(present=True, is_many=True, json=json, filled=F.size(self.parts) > 0, pretty=pretty(json))
        at = None
        if len(path.parts) == 2 and path.parts[0] == "_array":
            at = _index(path.parts[1])
        elif len(path.parts) == 1 and (m := re.fullmatch(rf"{self.prefix}_(0|[1-9][0-9]{{0,8}})", path.parts[0])):
            at = int(m[1])
        if at is None:
            return Cell()
        found = self.at(at)
        return Cell(present=found.isNotNull(), is_text=True, text=found)


class Text(Words):
    """Lines of text: one of the first words is read off the line, without splitting the rest."""

    def __init__(self, parts: Column, raw: Column, blanks: str = BLANKS):
        super().__init__(parts, raw)
        self.blanks = blanks

    def at(self, i: int) -> Column:
        if i >= NEAR:
            return super().at(i)
        b = self.blanks
        return F.nullif(F.regexp_extract(self.raw, f"^[{b}]*(?:[^{b}]++[{b}]++){{{i}}}([^{b}]+)", 1), F.lit(""))


class Fields(Words):
    prefix = "field"


class Pairs(Binding):
    """Lines of logfmt: a simple line is searched for the key, others come as a map of texts."""

    def __init__(self, simple: Column, pairs: Column, raw: Column):
        self.simple, self.pairs, self.raw = simple, pairs, raw

    def cell(self, path: Path) -> Cell:
        if path.is_original:
            return _original(self.raw)
        if len(path.parts) != 1:
            return Cell()
        key = path.parts[0]
        mapped = F.try_element_at(self.pairs, F.lit(key))
        if not key or re.search(f"[{BLANKS}=\"\\\\]", key):
            found = F.when(~self.simple, mapped)
        else:
            # The last of several pairs with one key counts.
            own = "".join(c if c.isalnum() or c == "_" else f"\\x{{{ord(c):x}}}" for c in key)
            pattern = f"(?s)^(?:.*[{BLANKS}])?{own}=([^{BLANKS}]*)"
            found = F.when(self.simple, F.when(self.raw.rlike(pattern), F.regexp_extract(self.raw, pattern, 1))).otherwise(mapped)
        return Cell(present=found.isNotNull(), is_text=True, text=found)

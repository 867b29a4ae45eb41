"""Queries on tables against a plain reading of the semantics, row by row; and what their plans push down."""

import datetime
import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamis import api
from tamis.functions.jsontext import dumps
from tamis.functions.text import parse_number
from tamis.plans import ast
from tamis.plans.parser import compile_expression

SCHEMA = "s string, i int, n bigint, x double, b boolean, a array<int>, o struct<s:string,i:int>, m map<string,int>"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
ROWS = [
    ("5", 5, 5, 5.0, True, [1, 2], {"s": "x", "i": 1}, {"k": 1}),
    (None, None, None, None, None, None, None, None),
    ("", 0, 0, 0.0, False, [], {"s": None, "i": None}, {}),
    ("5.0", -3, 2**40, 0.1 + 0.2, True, [None], {"s": "null", "i": 7}, {"k": None}),
    ("nan", 1, -1, 1e20, False, [3], {"s": "", "i": 0}, {"j": 2}),
    ("no", 2147483647, 3, -2.5, True, [0], {"s": "é", "i": -1}, {"k": 0}),
    ("null", 30, 30, 30.0, True, [5, 5, 5], {"s": "30", "i": 30}, {"k": 30}),
]
MISSING = object()


def get(row: dict, path: ast.Path):
    value = row
    for part in path.parts:
        if isinstance(value, dict) and part in value:
            value = value[part]
        elif isinstance(value, list) and part.isdigit() and int(part) < len(value):
            value = value[int(part)]
        else:
            return MISSING
    return value


def shown(v) -> str:
    return v if isinstance(v, str) else dumps(v)


def number(v) -> float | None:
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, (int, float)):
        return float(v)
    return parse_number(shown(v)) if isinstance(v, str) else None


def same(a, v) -> bool:
    many = isinstance(a, (list, dict))
    a = shown(a) if many else a
    if isinstance(v, ast.Null) or v is None:
        return a is None
    if isinstance(v, ast.Boolean) or isinstance(v, bool):
        return isinstance(a, bool) and a == (v.value if isinstance(v, ast.Boolean) else v)
    if isinstance(v, ast.Text) or isinstance(v, str):
        text = v.value if isinstance(v, ast.Text) else v
        if isinstance(a, str):
            return a == text
        x, y = number(a), parse_number(text)
        return x is not None and y is not None and abs(x - y) < 2.0**-52
    if isinstance(v, (ast.Number, int, float)):
        x, y = number(a), float(v.value if isinstance(v, ast.Number) else v)
        return x is not None and abs(x - y) < 2.0**-52
    return False


def holds(f, row) -> bool:
    if isinstance(f, ast.And):
        return holds(f.left, row) and holds(f.right, row)
    if isinstance(f, ast.Or):
        return holds(f.left, row) or holds(f.right, row)
    if isinstance(f, ast.Not):
        return not holds(f.inner, row)
    a = get(row, f.path)
    if a is MISSING:
        return False
    if isinstance(f, ast.Truthy):
        if isinstance(a, str):
            return a.lower() not in ("false", "f", "0", "no", "off", "")
        return bool(a)
    v = f.value
    if isinstance(v, ast.Path):
        v = get(row, v)
        if v is MISSING:
            return False
        v = shown(v) if isinstance(v, (list, dict)) else v
    if f.op in ("==", "!="):
        return same(a, v) == (f.op == "==")
    if f.op in ("<", "<=", ">", ">="):
        x = number(a)
        y = v.value if isinstance(v, ast.Number) else parse_number(v.value) if isinstance(v, ast.Text) else number(v) if isinstance(v, (int, float, str)) else None
        if x is None or y is None or math.isnan(x) or math.isnan(y):
            return False
        return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[f.op]
    text = v.value if isinstance(v, ast.Text) else v if isinstance(v, str) else None
    if f.op == "~=":
        pattern = v.pattern if isinstance(v, ast.Regex) else text
        return pattern is not None and re.search(pattern, shown(a)) is not None
    if text is None:
        return False
    return {"*=": text in shown(a), "~": text in shown(a), "^=": shown(a).startswith(text), "$=": shown(a).endswith(text)}[f.op]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(1).withColumn("row", F.monotonically_increasing_id()).cache()


PATHS = st.sampled_from(["s", "i", "n", "x", "b", "a", "o", "o.s", "o.i", "m.k", "a.0", "a.2", "nope", "s.t", "o.nope"])
VALUES = st.sampled_from(['"5"', '"5.0"', '"null"', '"x"', '""', '"30"', '"[1,2]"', "5", "5.0", "0", "0.3", "30", "-2.5", "2.5", "3000000000", "true", "false", "null", "s", "i", "x", "o.s", "a", "nope", "b"])
OPS = st.sampled_from(["==", "!=", "<", "<=", ">", ">=", "*=", "~", "^=", "$="])
LEAVES = st.one_of(st.builds(lambda p, o, v: f"{p} {o} {v}", PATHS, OPS, VALUES), PATHS.map(lambda p: p + "?"), PATHS.map(lambda p: p + " ~= /^[5x]/"))
FILTERS = st.recursive(LEAVES, lambda f: st.one_of(st.builds(lambda a, b: f"({a}) && ({b})", f, f), st.builds(lambda a, b: f"({a}) || ({b})", f, f), f.map(lambda a: f"!({a})")), max_leaves=3)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(FILTERS, min_size=25, max_size=25, unique=True))
def test_filters_like_row_by_row(rows, filters):
    from tamis.operators.cells import column
    from tamis.operators.typed import Typed

    typed = Typed(rows)
    compiled = [compile_expression(f).filter for f in filters]
    got = rows.select("row", *[F.coalesce(column(typed.holds(f)), F.lit(False)).alias(f"f{k}") for k, f in enumerate(compiled)]).orderBy("row").collect()
    for values, found in zip(ROWS, got, strict=True):
        row = dict(zip(NAMES, values, strict=True))
        for k, f in enumerate(compiled):
            assert found[f"f{k}"] == holds(f, row), (filters[k], row)


def test_rendering(rows):
    got = [r["value"] for r in api.query(rows, "[${s}|${i}|${x}|${b}|${a}|${o}|${m}|${o.i}|${a.1}|${nope}]").collect()]
    for values, found in zip(ROWS, got, strict=True):
        row = dict(zip(NAMES, values, strict=True))
        parts = [get(row, ast.Path(tuple(p.split(".")))) for p in ("s", "i", "x", "b", "a", "o", "m", "o.i", "a.1", "nope")]
        assert found == "|".join("" if p is MISSING else shown(p) for p in parts)


def test_selectors(rows):
    assert [r["value"] for r in api.query(rows, "a.0").collect()] == ["1", "null", "3", "0", "5"]
    assert api.query(rows, "o").first()["value"] == '{\n  "i": 1,\n  "s": "x"\n}'
    assert api.query(rows, "nope").count() == 0
    assert api.where(rows, "i > 1").columns == rows.columns


def pushed(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    return "".join(re.findall(r"PushedFilters: \[(.*?)\], ReadSchema: (\S+)", plan)[0])


@pytest.mark.parametrize(
    ("expression", "parts"),
    [
        ('event_type == "error" && value > 100 $user_id', ["EqualTo(event_type,error)", "GreaterThan(value,100.0)", "struct<user_id:bigint,event_type:string,value:double>"]),
        ('event_type != "error" $event_id', ["Or(IsNull(event_type),Not(EqualTo(event_type,error)))"]),
        ('event_type ^= "e" || event_type ~ "li" {x}', ["StringStartsWith(event_type,e)", "StringContains(event_type,li)"]),
        ("user_id >= 2.5 && user_id != 7 $user_id", ["GreaterThanOrEqual(user_id,3)", "EqualTo(user_id,7)"]),
        ("!(user_id > 10) $user_id", ["LessThanOrEqual(user_id,10)"]),
        ("value == 2 {x}", ["EqualTo(value,2.0)"]),
    ],
)
def test_scans_take_the_filters(spark, tmp_path, expression, parts):
    spark.createDataFrame([(1, 2, "error", 150.0)], "event_id bigint, user_id bigint, event_type string, value double").write.parquet(str(tmp_path / "t"))
    found = pushed(api.query(spark.read.parquet(str(tmp_path / "t")), expression))
    assert all(p in found for p in parts), found


def test_times_are_text(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 2, 3, 4, 5),)], "t timestamp_ntz")
    assert api.query(df, 't ^= "2024-01" && t? $t').first()["value"] == "2024-01-02T03:04:05.000000"

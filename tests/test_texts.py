"""Expressions on texts of every format: what is printed, line by line."""

import pytest

from tamis import api, cli
from tamis.sources.decode import Registry, decode, line_format, logfmt_value
from tamis.sources.detect import detect

WIDE = '{"name":"Alice","email":"alice@example.com","role":"admin","text":"say hi","age":30,"a":5,"b":5,"limit":25,"count":0,"score":98.5,"threshold":95.0,"version":"2.0","active":true,"banned":false,"nothing":null,"user":{"verified":true,"name":"Al"},"items":["x","y"],"empty":[],"big":1e20,"no":"no"}'

#: (text, expression, printed lines)
CASES = [
    (WIDE, "name", ["Alice"]),
    (WIDE, "user.name", ["Al"]),
    (WIDE, "items.1", ["y"]),
    (WIDE, "items.5", []),
    (WIDE, "nope", []),
    (WIDE, "nothing", ["null"]),
    (WIDE, "score", ["98.5"]),
    (WIDE, "threshold", ["95.0"]),
    (WIDE, "big", ["1e20"]),
    (WIDE, "items", ["[", '  "x",', '  "y"', "]"]),
    (WIDE, "user", ["{", '  "name": "Al",', '  "verified": true', "}"]),
    (WIDE, "empty", ["[]"]),
    (WIDE, "[${user}|${items}|${nothing}|${nope}|${active}|${threshold}]", ['{"name":"Al","verified":true}|["x","y"]|null||true|95.0']),
    (WIDE, 'age > 25 && role == "admin" [${name}]', ["Alice"]),
    (WIDE, "age > 30 {x}", []),
    (WIDE, 'age >= "30" {x}', ["x"]),
    (WIDE, 'age == "30" {x}', ["x"]),
    (WIDE, "version == 2 {x}", ["x"]),
    (WIDE, 'version == "2" {x}', []),
    (WIDE, "score >= threshold {x}", ["x"]),
    (WIDE, "a == b {x}", ["x"]),
    (WIDE, "nothing == null {x}", ["x"]),
    (WIDE, "nope == null {x}", []),
    (WIDE, "nope != 1 {x}", []),
    (WIDE, "!(nope == 1) {x}", ["x"]),
    (WIDE, "nothing != 1 {x}", ["x"]),
    (WIDE, "active == true {x}", ["x"]),
    (WIDE, 'active == "true" {x}', []),
    (WIDE, 'nothing ~ "ul" {x}', ["x"]),
    (WIDE, 'items ~ "\\"x\\"" {x}', ["x"]),
    (WIDE, 'items == "[\\"x\\",\\"y\\"]" {x}', ["x"]),
    (WIDE, 'email $= ".com" && name ^= "Al" {x}', ["x"]),
    (WIDE, "email ~= /^ALICE@/i {x}", ["x"]),
    (WIDE, 'text ~= "[bad" {x}', []),
    (WIDE, "count? {x}", []),
    (WIDE, "no? {x}", []),
    (WIDE, "empty? {x}", []),
    (WIDE, "user? {x}", ["x"]),
    (WIDE, 'name < "b" {x}', []),
    (WIDE, "${active?yes:no}", ["yes"]),
    (WIDE, "${banned?yes:$name}", ["Alice"]),
    (WIDE, "$20", ["$20"]),
    (WIDE, "age == 30", [WIDE]),
    ('{"a":1}\n{"a":2}\n{"b":3}\n', "a", ["1", "2"]),
    ('{"a":1} {"a":\n2}', "a > 1", ['{"a":\n2}']),
    ('[{"a":1},{"a":2},7]', "a", ["1", "2"]),
    ('[{"a":1},{"a":2}]', "a > 1", ['[{"a":1},{"a":2}]']),
    ("42", "a", [""]),
    ("name: Alice\nage: 30\nid: 0042\nwhen: 2024-01-15\nyes: no\n", "[${name} ${age} ${id} ${when} ${yes}]", ["Alice 30 0042 2024-01-15 no"]),
    ("name: Alice", "name", ["Alice"]),
    ("---\nname: Alice\n---\nname: Bob\n", "name", ["", "Alice", "", "Bob"]),
    ("a:\n  b: &x [1, 2.50]\n  c: *x\n", "a.c.1", ["2.5"]),
    ('title = "T"\nwhen = 2024-01-15\n[db]\nhost = "h"\nports = [1, 2]\n', "[${title} ${db.host} ${db.ports.1} ${when}]", ["T h 2 2024-01-15"]),
    ("name,age,job\nAlice,30,dev\nBob,25,ops\n", "name", ["Alice", "Bob"]),
    ("name,age,job\nAlice,30,dev\nBob,25,ops\n", "age > 26 [${1}-${job}-${field_1}]", ["Alice-dev-30"]),
    ("name,age,job\nAlice,30,dev\nBob,25,ops\n", "age > 26", ["Alice,30,dev"]),
    ("Name,Age\nAlice,30\n", "name", ["Alice"]),
    ("Alice,30\nBob,25\n", "field_0", ["Alice", "Bob"]),
    ('"Smith, John",35\nBob,4\n', "field_0", ["Smith, John", "Bob"]),
    ("a,b\nc,d,e\nf\n", "field_1", ["b", "d", ""]),
    ('level=info msg="two words" port=80 x=\nlevel=warn msg=\\"q\\"\n', "[${level}|${msg}|${port}]", ["info|two words|80", "warn|q|"]),
    ("level=info a=1\nnope\nlevel=warn a=2\n", "level", ["info", "warn"]),
    ("level=info a=1\nlevel=warn a=2\n", "a == 2 $level", ["warn"]),
    ("hello big  world\n\ncafé 123 français\n", "word_1", ["big", "123"]),
    ("ERROR disk full\nINFO fine\n", 'word_0 == "ERROR"', ["ERROR disk full"]),
    ("one two\nthree\n", "word_1", ["two", ""]),
    ('{"name": "Alice"', "word_1", ['"Alice"']),
    ("", "name", []),
    ("a b\n", "", ["a b"]),
]


@pytest.fixture(scope="module")
def answers(spark):
    """All cases of one expression run as one job."""
    found = {}
    for expression in dict.fromkeys(e for _, e, _ in CASES):
        sources = list(dict.fromkeys(t for t, e, _ in CASES if e == expression))
        printed = {i: [] for i in range(len(sources))}
        for r in api.run_texts(spark, sources, expression).values.orderBy("source", "at").collect():
            printed[r["source"]] += r["value"].split("\n")
        found |= {(t, expression): printed[i] for i, t in enumerate(sources)}
    return found


@pytest.mark.parametrize(("text", "expression", "printed"), CASES)
def test_printed(answers, text, expression, printed):
    assert answers[text, expression] == [x for p in printed for x in p.split("\n")]


def test_forced_formats(spark):
    text = "{name: Alice, age: 30}"
    assert api.run_texts(spark, [text], "name", fmt="yaml").collect() == ["Alice"]
    assert api.run_texts(spark, ["name: Al\nage: 3\n"], "word_0", fmt="json").collect() == ["", ""]


def test_echo_and_problems(spark):
    found = api.run_texts(spark, ["a=1\n\nbad\nb=2\n"])
    assert found.collect() == ["a=1", "b=2"]
    assert [(r["at"], r["line"]) for r in found.problems.collect()] == [(3, "bad")]
    with pytest.raises(api.BrokenFirstLine):
        api.run_texts(spark, ["= 1\n"]).collect()


def test_sources_in_order(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"a": "x"}')
    (tmp_path / "a.csv").write_text("a,n\ny,1\nz,2\n")
    paths = [(tmp_path / n).as_uri() for n in ("b.json", "a.csv")]
    assert api.run_files(spark, paths, "a").collect() == ["x", "y", "z"]


def test_filter_without_template(spark):
    assert api.run_texts(spark, ['{"a": 1}\n{"a": 9}\n7\n'], "a > 5", "").collect() == ['{"a": 9}']
    assert api.run_texts(spark, ["7\n"], "!(a > 5)", "").collect() == ["7"]


def test_convert(spark):
    docs = api.texts.of_texts(spark, ["a,b\nc,d\n", "x=1 y=2\n", "two words\n", '{"b":1,"a":[1.50]}\n'])
    assert [r["value"] for r in api.convert(docs).orderBy("source", "at").collect()] == ['["a","b"]', '["c","d"]', '{"x":"1","y":"2"}', '["two","words"]', '{"a":[1.5],"b":1}']


LINES = {
    "json": (['{"a": 1, "n": "x"}', "", "[1]", "nope", '{"a": 12}'], "a > 5 [${a}]", ["12"]),
    "text": (["ERROR disk full", "  ", "INFO ok"], 'word_0 == "ERROR" [${word_1} ${_array.2}]', ["disk full"]),
    "logfmt": (["a=1 b=x a=7", 'a="8" b="y z"', "bad", "a=2"], "a > 5 [${a} ${b}]", ["7 x", "8 y z"]),
    "csv": (["x,1", '"y,y",9', "z,8"], "field_1 > 5 [${field_0}]", ["y,y", "z"]),
}


@pytest.mark.parametrize("fmt", LINES)
def test_lines(spark, fmt):
    rows, expression, printed = LINES[fmt]
    df = spark.createDataFrame([(x,) for x in rows], "value string")
    assert sorted(r["value"] for r in api.run_lines(df, fmt, expression).collect()) == sorted(printed)


def test_every_line(spark):
    df = spark.createDataFrame([(x,) for x in ("a\xa0b c", " ", None, "d e")], "value string")
    printed = lambda *a, **k: [r["value"] for r in api.run_lines(df, "text", *a, **k).collect()]
    assert printed("word_1") == ["b", "e"]
    assert printed("word_1", blanks=" ", every=True) == ["c", None, None, "e"]
    assert printed("_array.0", blanks=" ", every=True) == ["a\xa0b", None, None, "d"]
    assert printed('word_0 == "d" [${word_1}]', every=True) == ["e"]
    with pytest.raises(ValueError):
        api.run_lines(df, "json", "a", every=True)


def test_command_line(spark, tmp_path, capsys):
    import io

    out, err = io.StringIO(), io.StringIO()
    assert cli.main(["age > 25 [${name}]"], spark, io.StringIO('{"name":"Al","age":30}'), out, err) == 0
    assert out.getvalue() == "Al\n"
    assert cli.main(["name age"], spark, io.StringIO(""), out, err) == 1
    assert cli.main(["a", "-f", str(tmp_path / "missing")], spark, None, out, err) == 1
    assert cli.main(["--examples"], spark, None, out, err) == 0 and "Filter" in out.getvalue()


def test_detection():
    assert detect('{"a":1}')[0] == ("json", 0.9) and detect(" [1]")[0] == ("json_array", 0.9)
    assert detect("---\na: 1")[0] == ("yaml", 0.95) and detect("[a]\nb = 1")[:2] == [("json_array", 0.9), ("toml", 0.8)]
    assert detect("a: 1\nb: 2")[0] == ("yaml", 0.7) and detect("a,b\nc,d")[0] == ("csv", 0.6)
    assert detect("a=1 b=2")[0] == ("logfmt", 0.5) and detect("plain")[0] == ("text", 0.1)
    assert detect("é" * 99 + "€")[-1] == ("text", 0.1)
    assert [line_format(x) for x in ("42", "a: b", "a = 1", "a=1", "a,b", "a b")] == ["json", "yaml", "toml", "logfmt", "csv", "text"]


def test_logfmt_escapes():
    assert logfmt_value('a="x\\"y\\n\\q" b=\\"c d\\" e=f"g') == {"a": 'x"y\n\\q', "b": "c d", "e": 'f"g'}
    assert logfmt_value("k=\\x y=1") == {"k": "", "\\x y": "1"}


def test_broken_json_values():
    for text in ('{"a": NaN}', '{"a": 1e999}', '{"a":"\\ud800"}', "[" * 400, '{"a":1'):
        assert all(r.line for r in decode(text))


def test_registry():
    r = Registry()
    assert r.parse('{"a": 1}') == ({"a": 1}, "JSON") and r.parse("a = 1\nb = 2") == ({"a": 1, "b": 2}, "TOML")
    assert r.parse("a: 1\nb: 2") == ({"a": 1, "b": 2}, "YAML") and r.formats() == ["JSON", "TOML", "YAML"]


def test_stream(spark, tmp_path):
    from tamis.streaming import lines

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("level=info n=1\nlevel=warn n=5\n")
    read = lambda: spark.readStream.text(str(tmp_path / "in"))
    for _ in range(2):
        lines.start(read(), "n > 2 $level", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        (tmp_path / "in" / "b.txt").write_text("level=error n=9\nplain text\n")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/out/*").collect()) == ["error", "warn"]

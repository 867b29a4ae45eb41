"""Texts of any format as records.

A record is a JSON value with the text it came from. ``decode`` takes a whole text: it tries the likely formats of a
document in turn and otherwise goes line by line, in the format of the first line that is not blank.
"""

from __future__ import annotations

import csv
import datetime
import io
import re
from dataclasses import dataclass

from tamis.functions.jsontext import NotJson, checked, loads, stream
from tamis.plans.ast import ORIGINAL
from tamis.sources.detect import BLANKS, CSV, JSON, JSON_ARRAY, LEAST_CONFIDENCE, LOGFMT, TEXT, TOML, YAML, compatible, detect, lines, trim, words

csv.field_size_limit(2**31 - 1)


class Broken(ValueError):
    """Text that is not in the format."""


@dataclass
class Record:
    value: object
    raw: str | None  # the original text, for objects only
    at: int  # physical line, or place in the document
    line: bool = False
    broken: str | None = None  # why there is no value
    echo: str = ""  # the line itself


# formats ---------------------------------------------------------------------------------------------


def json_value(text: str) -> object:
    try:
        return loads(text)
    except NotJson as e:
        raise Broken(str(e)) from None


def toml_value(text: str) -> object:
    import tomllib

    try:
        return _plain(tomllib.loads(text))
    except (ValueError, RecursionError) as e:
        raise Broken(str(e)) from None


def _plain(x: object) -> object:
    """TOML's dates and times become their ISO text, infinities and NaN null."""
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    if isinstance(x, (datetime.datetime, datetime.date, datetime.time)):
        return x.isoformat().replace("+00:00", "Z")
    if isinstance(x, int) and not isinstance(x, bool) and not -(2**63) <= x < 2**63:
        raise ValueError("number out of range")
    return x


_loader = None


def _yaml_loader():
    """A loader with the scalars of YAML 1.2: no yes and no, no sexagesimals, no dates, no numbers with leading zeros."""
    global _loader
    if _loader is not None:
        return _loader
    try:
        import yaml
    except ImportError as e:
        raise Broken("no YAML library") from e

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers = {}

        def mapping(self, node, deep=True):
            found = {}
            for k, v in node.value:
                key = self.construct_object(k, deep=True)
                if key is None or isinstance(key, (list, dict)):
                    raise yaml.constructor.ConstructorError(None, None, "key is no text", k.start_mark)
                key = key if isinstance(key, str) else _scalar_text(key)
                if key in found:
                    raise yaml.constructor.ConstructorError(None, None, "key occurs twice", k.start_mark)
                found[key] = self.construct_object(v, deep=True)
            return found

    text = "tag:yaml.org,2002:"
    for tag, pattern, first in (
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
        ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
        ("int", r"^(?:[-+]?(?:0|[1-9][0-9]*)|[-+]?0x[0-9a-fA-F]+|[-+]?0o[0-7]+|[-+]?0b[01]+)$", "-+0123456789"),
        ("float", r"^(?:[-+]?(?:\.[0-9]+|(?:0|[1-9][0-9]*)(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+0123456789."),
    ):
        Loader.add_implicit_resolver(text + tag, re.compile(pattern), list(first))
    Loader.add_constructor(text + "map", Loader.mapping)
    Loader.add_constructor(text + "int", lambda l, n: _yaml_int(l.construct_scalar(n)))
    Loader.add_constructor(text + "float", lambda l, n: _yaml_float(l.construct_scalar(n)))
    Loader.add_constructor(text + "bool", lambda l, n: l.construct_scalar(n).lower() == "true")
    for tag in ("binary", "timestamp", "omap", "pairs", "set"):
        Loader.add_constructor(text + tag, None)
        del Loader.yaml_constructors[text + tag]
    _loader = (yaml, Loader)
    return _loader


def _scalar_text(x: object) -> str:
    from tamis.functions.jsontext import dumps

    return dumps(x)


def _yaml_int(s: str) -> int | float:
    n = int(s.replace("+", ""), 0) if s.lstrip("+-")[:2].lower() in ("0x", "0o", "0b") else int(s)
    return n if -(2**63) <= n < 2**64 else float(n)


def _yaml_float(s: str) -> float | None:
    low = s.lower()
    return None if low.endswith((".inf", ".nan")) else float(s)


def yaml_value(text: str) -> object:
    yaml, loader = _yaml_loader()
    try:
        return checked(yaml.load(text, Loader=loader))  # noqa: S506  a safe loader
    except (yaml.YAMLError, NotJson, ValueError, TypeError, RecursionError) as e:
        raise Broken(str(e)) from None


def csv_rows(text: str) -> list[list[str] | None]:
    """The records of a text, blank lines aside; one with another number of fields than the first is None."""
    found: list[list[str] | None] = []
    width = None
    for row in csv.reader(io.StringIO(text, newline="")):
        if not row:
            continue
        width = len(row) if width is None else width
        found.append(row if len(row) == width else None)
    return found


def csv_line(text: str) -> list[str]:
    rows = csv_rows(text)
    if not rows:
        raise Broken("no record")
    return rows[0]


def _numeric(field: str) -> bool:
    return bool(re.fullmatch(f"[0-9.+{BLANKS}-]*[0-9][0-9.+{BLANKS}-]*", field))


def _datum(field: str) -> bool:
    return _numeric(field) or any(sign in field for sign in ("@", "http")) or ("-" in field and "_" not in field)


def _name(field: str) -> bool:
    return not {"_", " "}.isdisjoint(field) or all(c.isalpha() and not c.isupper() for c in field)


def _cells(line: str) -> list[str]:
    """The trimmed fields of a line; none where it holds no record."""
    try:
        return [trim(f) for f in csv_line(line)]
    except Broken:
        return []


def has_header(all_lines: list[str]) -> bool:
    """Whether the first line names columns: it holds no number and no blank, and the lines after it look like data or it like names."""
    first, *others = map(_cells, all_lines[:6]) if len(all_lines) > 1 else [[]]
    could = bool(first) and all(f and not _numeric(f) for f in first)
    return could and (any(_datum(f) for row in others for f in row) or any(map(_name, first)))


def _places(names: list[str], width: int) -> list[tuple[str, int]]:
    """The keys of a record and the places of their fields: by number, by field_i, and by the header's names, which come last and so win."""
    by_number = [(key, i) for i in range(width) for key in (f"{i + 1}", f"field_{i}")]
    return by_number + [(key.replace("*", name), i) for i, name in enumerate(names[:width]) for key in ("*", "$*", "${*}")]


def csv_document(text: str) -> list[Record]:
    """Records with their fields under 1, 2, ..., field_0, field_1, ... and the header's names in lower case.

    The original text of the n-th record is the n-th physical line, also after blank lines and line breaks in quotes.
    """
    physical, rows = lines(text), csv_rows(text)
    if not physical or not rows:
        raise Broken("no record")
    header = has_header(physical)
    places = _places([name.lower() for name in _cells(physical[0])] if header else [], len(rows[0]))
    found = []
    for i in range(int(header), len(rows)):
        if (row := rows[i]) is not None:
            own = physical[i] if i < len(physical) else None
            whole = {"0": trim(text)} if own is None else {"0": own, "${0}": own}
            value = whole | {key: row[place] for key, place in places} | {"_array": row}
            raw = value.pop(ORIGINAL, own)
            found.append(Record(value, raw if isinstance(raw, str) else own, i))
    return found


_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}
_BLANK = re.compile(f"[{BLANKS}]*")
_BARE = re.compile(f"[^{BLANKS}]*")


def _quoted(line: str, at: int, bare_end: bool) -> tuple[str, int]:
    """A value up to its closing quote, which is a bare one or an escaped one, or to the end of the line."""
    out = []
    while at < len(line):
        c = line[at]
        if c == "\\":
            if not bare_end and line.startswith('"', at + 1):
                return "".join(out), at + 2
            if at + 1 < len(line):
                out.append(_ESCAPED.get(line[at + 1], line[at : at + 2]))
            at += 2
        elif c == '"' and bare_end:
            return "".join(out), at + 1
        else:
            out.append(c)
            at += 1
    return "".join(out), at


def logfmt_value(line: str) -> dict[str, str]:
    """Pairs key=value. A key is all up to the next equals sign; a line that ends inside a key is broken."""
    found: dict[str, str] = {}
    at = _BLANK.match(line, 0).end()
    while at < len(line):
        equals = line.find("=", at)
        if equals < 0:
            raise Broken("no value")
        key, at = line[at:equals], equals + 1
        if key:
            if line.startswith('\\"', at):
                value, at = _quoted(line, at + 2, False)
            elif line.startswith("\\", at):
                value = ""
            elif line.startswith('"', at):
                value, at = _quoted(line, at + 1, True)
            else:
                m = _BARE.match(line, at)
                value, at = m[0], m.end()
            found[trim(key)] = value
        at = _BLANK.match(line, at).end()
    if not found:
        raise Broken("no pair")
    return found


def text_value(line: str) -> dict[str, object]:
    own = words(line)
    return {**{f"word_{i}": w for i, w in enumerate(own)}, "_array": own}


def csv_line_value(line: str) -> dict[str, object]:
    own = csv_line(line)
    return {**{f"field_{i}": f for i, f in enumerate(own)}, "_array": own}


LINE_VALUES = {JSON: json_value, YAML: yaml_value, TOML: toml_value, LOGFMT: logfmt_value, CSV: csv_line_value, TEXT: text_value}

# lines -----------------------------------------------------------------------------------------------


def _takes(parse, line: str) -> bool:
    try:
        parse(line)
    except Broken:
        return False
    return True


def line_format(line: str) -> str:
    """The format of a line: the first in order that its signs and, but for logfmt, its parser agree on."""
    pairs = any("=" in w for w in words(line))
    if _takes(json_value, line):
        return JSON
    if not pairs and (": " in line or line.startswith(("- ", "---"))) and _takes(yaml_value, line):
        return YAML
    if (" = " in line or line.startswith("[") and line.endswith("]")) and _takes(toml_value, line):
        return TOML
    if pairs:
        return LOGFMT
    commas = line.count(",")
    if commas and len(trim(line).encode()) > commas and _takes(csv_line, line):
        return CSV
    return TEXT


def line_records(all_lines: list[str]) -> list[Record]:
    found, own = [], None
    for i, line in enumerate(all_lines, 1):
        if not trim(line):
            continue
        own = own or line_format(line)
        try:
            value = LINE_VALUES[own](line)
        except Broken as e:
            found.append(Record(None, None, i, True, str(e) or own, line))
            continue
        found.append(Record(*_with_original(value, line), i, True, None, line))
    return found


def _with_original(value: object, raw: str) -> tuple[object, str | None]:
    """An object gives up a key of its own that names the original text; other values have no original text."""
    if isinstance(value, dict):
        value.pop(ORIGINAL, None)
        return value, raw
    return value, None


# documents -------------------------------------------------------------------------------------------


def _document(text: str, fmt: str) -> list[Record]:
    whole = trim(text)
    if fmt == JSON:
        try:
            value = json_value(text)
        except Broken:
            try:
                found = stream(text)
            except NotJson as e:
                raise Broken(str(e)) from None
            if not found:
                raise Broken("no value") from None
            return [Record(*_with_original(v, own), i) for i, (v, own) in enumerate(found)]
        if isinstance(value, list):
            raise Broken("an array")
        return [Record(*_with_original(value, whole), 0)]
    if fmt == JSON_ARRAY:
        value = json_value(text)
        if not isinstance(value, list):
            raise Broken("no array")
        return [Record(*_with_original(v, whole), i) for i, v in enumerate(value)]
    if fmt in (TOML, YAML):
        value = (toml_value if fmt == TOML else yaml_value)(text)
        return [Record(*_with_original(v, whole), i) for i, v in enumerate(value if isinstance(value, list) else [value])]
    if fmt == CSV:
        return csv_document(text)
    raise Broken("read by lines")


def decode(text: str, forced: str | None = None, by_line: bool = False) -> list[Record]:
    """The records of a whole text. forced keeps only the compatible candidates for documents; lines are read as they look."""
    if not by_line:
        for fmt, confidence in detect(text):
            if confidence < LEAST_CONFIDENCE:
                break
            if forced is not None and not compatible(fmt, forced):
                continue
            try:
                return _document(text, fmt)
            except Broken:
                continue
    return line_records(lines(text))


# registry --------------------------------------------------------------------------------------------


class Registry:
    """Parsers of whole documents by name; one can be added. Each is (name, format, whether it may try, parse)."""

    def __init__(self):
        self.parsers: list[tuple] = []
        self.register("JSON", (JSON, JSON_ARRAY), lambda t: trim(t)[:1] in ("{", "[") and _takes(json_value, t), json_value)
        self.register("TOML", (TOML,), lambda t: (TOML, 0.8) in detect(t) and _takes(toml_value, t), toml_value)
        self.register("YAML", (YAML,), lambda t: any(f == YAML for f, _ in detect(t)) and _takes(yaml_value, t), yaml_value)

    def register(self, name: str, formats: tuple[str, ...], can_parse, parse) -> None:
        self.parsers.append((name, formats, can_parse, parse))

    def parse(self, text: str) -> tuple[object, str]:
        """The value and the parser's name: likely formats first, then every parser that may try."""
        likely = [next((p for p in self.parsers if f in p[1]), None) for f, c in detect(text) if c > LEAST_CONFIDENCE]
        for name, _, _, parse in [p for p in likely if p] + [p for p in self.parsers if p[2](text)]:
            try:
                return parse(text), name
            except Broken:
                continue
        raise Broken("no parser took the text")

    def formats(self) -> list[str]:
        return [p[0] for p in self.parsers]

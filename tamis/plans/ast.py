"""The query form: a filter, a template and a field selector, each optional."""

from __future__ import annotations

from dataclasses import dataclass

#: The pseudo-field that holds a record's original text.
ORIGINAL = "$0"


@dataclass(frozen=True)
class Path:
    parts: tuple[str, ...]

    @property
    def is_original(self) -> bool:
        return self.parts == (ORIGINAL,)


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Boolean:
    value: bool


@dataclass(frozen=True)
class Null:
    pass


@dataclass(frozen=True)
class Regex:
    pattern: str
    flags: str = ""


Value = Text | Number | Boolean | Null | Regex | Path


@dataclass(frozen=True)
class Compare:
    """op is one of == != < <= > >= (ordering is numeric only) and *= ~ ^= $= ~= (on text)."""

    path: Path
    op: str
    value: Value


@dataclass(frozen=True)
class Truthy:
    path: Path


@dataclass(frozen=True)
class And:
    left: Filter
    right: Filter


@dataclass(frozen=True)
class Or:
    left: Filter
    right: Filter


@dataclass(frozen=True)
class Not:
    inner: Filter


Filter = Compare | Truthy | And | Or | Not


@dataclass(frozen=True)
class Choice:
    """``${path?yes:no}``"""

    path: Path
    yes: Template
    no: Template


@dataclass(frozen=True)
class Template:
    """Literal strings, paths and choices, in order."""

    items: tuple[str | Path | Choice, ...]


@dataclass(frozen=True)
class Query:
    filter: Filter | None = None
    template: Template | None = None
    selector: Path | None = None

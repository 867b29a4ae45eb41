"""Patterns of a linear-time regex dialect, rewritten for Java's, or the verdict that they are no pattern there.

The source dialect has no look-around, back-references, possessive quantifiers or atomic groups. A pattern that it
refuses is searched for as plain text instead, so what Java alone accepts must be refused here as well.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Letters that may follow a backslash in the source dialect.
_ESCAPES = set("dDwWsSbBAzaftnrvxuUpP")
_SIGNS = set("\\.+*?()|[]{}^$#&-~/ !\"%',:;<=>@_`")
#: Names of ASCII classes and their Java forms.
_CLASSES = {"alpha": "\\p{Alpha}", "digit": "0-9", "alnum": "\\p{Alnum}", "upper": "\\p{Upper}", "lower": "\\p{Lower}", "space": "\\s", "punct": "\\p{Punct}", "cntrl": "\\p{Cntrl}", "graph": "\\p{Graph}", "print": "\\p{Print}", "xdigit": "0-9A-Fa-f", "blank": " \\t", "word": "\\w", "ascii": "\\x00-\\x7F"}


class _Refused(Exception):
    pass


@dataclass(frozen=True)
class Search:
    """java: pattern for an unanchored search; else plain: text to search for, folded where fold is set."""

    java: str | None
    plain: str = ""
    fold: bool = False


def _escape(text: str, at: int, in_class: bool) -> tuple[str, int]:
    if at + 1 >= len(text):
        raise _Refused
    c = text[at + 1]
    if c == "v":
        return "\\x0B", at + 2
    if c in "uUx":
        if m := re.compile(r"\{([0-9A-Fa-f]{1,8})\}").match(text, at + 2):
            return f"\\x{{{m[1]}}}", m.end()
        n = {"x": 2, "u": 4, "U": 8}[c]
        digits = text[at + 2 : at + 2 + n]
        if len(digits) < n or not re.fullmatch(r"[0-9A-Fa-f]+", digits):
            raise _Refused
        return f"\\x{{{digits}}}", at + 2 + n
    if c in "pP":
        m = re.compile(r"\{\^?[A-Za-z_=:& -]+\}|[A-Z]").match(text, at + 2)
        if not m:
            raise _Refused
        name, letter = m[0].strip("{}"), c
        if name.startswith("^"):
            name, letter = name[1:], "P" if c == "p" else "p"
        name = name.rpartition("=")[2].strip()
        return f"\\{letter}{{{name if len(name) < 3 else 'Is' + name}}}", m.end()
    if in_class and c in "bBAz" or c not in _ESCAPES and c not in _SIGNS:
        raise _Refused
    return (f"\\{c}" if c.isascii() else re.escape(c)), at + 2


def translate(pattern: str, multiline: bool = False) -> str:
    """The Java pattern; raises _Refused for what the source dialect refuses."""
    out, at, open_, atom = [], 0, 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            part, at = _escape(pattern, at, False)
            out.append(part)
            atom = True
        elif c == "[":
            part, at = _set(pattern, at)
            out.append(part)
            atom = True
        elif c == "(":
            open_ += 1
            if pattern.startswith("(?", at):
                m = re.compile(r"\(\?(?:P?<([A-Za-z_][A-Za-z0-9_]*)>|([imsUux]*(?:-[imsUux]+)?)([:)]))").match(pattern, at)
                if not m:
                    raise _Refused
                if m[1]:
                    out.append(f"(?<{m[1].replace('_', 'U')}>")
                else:
                    out.append(f"(?{m[2].replace('u', '')}{m[3]}")
                    open_ -= m[3] == ")"
                at = m.end()
            else:
                out.append("(")
                at += 1
            atom = False
        elif c == ")":
            open_ -= 1
            if open_ < 0:
                raise _Refused
            out.append(")")
            at, atom = at + 1, True
        elif c in "*+?{":
            m = re.compile(r"[*+?]|\{\s*[0-9]+\s*(?:,\s*[0-9]*\s*)?\}").match(pattern, at)
            if not m or not atom:
                raise _Refused
            at = m.end()
            lazy = pattern.startswith("?", at)
            at += lazy
            out.append(re.sub(r"\s", "", m[0]) + "?" * lazy)
            if pattern.startswith("+", at) or pattern.startswith("*", at):
                out.append("")
                # A quantifier on a quantifier: the source dialect repeats the repetition.
                out[-2] = out[-2] + ")"
                out.insert(_atom_start(out[:-1]), "(?:")
        elif c == "$":
            out.append("$" if multiline else "\\z")
            at, atom = at + 1, True
        elif c == "}":
            out.append("\\}")
            at, atom = at + 1, True
        else:
            out.append(c)
            at, atom = at + 1, c != "|"
    if open_:
        raise _Refused
    return "".join(out)


def _atom_start(out: list[str]) -> int:
    """Where the atom before a quantifier begins."""
    i, depth = len(out) - 2, 0
    while i >= 0:
        if out[i] == ")":
            depth += 1
        elif out[i].startswith("("):
            depth -= 1
            if not depth:
                return i
        elif not depth:
            return i
        i -= 1
    return 0


def _set(text: str, at: int) -> tuple[str, int]:
    out, at = ["["], at + 1
    if text.startswith("^", at):
        out.append("^")
        at += 1
    first = True
    while at < len(text):
        c = text[at]
        if c == "]" and not first:
            return "".join([*out, "]"]), at + 1
        first = False
        if m := re.compile(r"\[:(\^?)([a-z]+):\]").match(text, at):
            if m[2] not in _CLASSES:
                raise _Refused
            out.append(f"[{m[1]}{_CLASSES[m[2]]}]")
            at = m.end()
        elif c == "[":
            part, at = _set(text, at)
            out.append(part)
        elif c == "\\":
            part, at = _escape(text, at, True)
            out.append(part)
        elif c == "]":
            out.append("\\]")
            at += 1
        else:
            out.append(c)
            at += 1
    raise _Refused


def search(pattern: str, flags: str = "") -> Search:
    """How to search for a pattern; of the flags i, m and s count, x does not."""
    fold = "i" in flags
    try:
        java = translate(pattern, "m" in flags)
    except _Refused:
        return Search(None, pattern, fold)
    inline = "dU" + "".join(f for f in "ims" if f in flags)
    if not _java_takes(f"(?{inline}){java}"):
        return Search(None, pattern, fold)
    return Search(f"(?{inline}){java}")


def of_row(pattern: str) -> str | None:
    """The Java form of a pattern that a row holds, or None; no JVM is at hand there, so an engine that refuses the same mistakes looks at it."""
    try:
        java = translate(pattern)
    except _Refused:
        return None
    try:
        import regex as engine
    except ImportError:
        import re as engine
    try:
        engine.compile(pattern)
    except Exception:  # noqa: BLE001  whatever the engine says, it is no pattern
        return None
    return f"(?dU){java}"


def _java_takes(java: str) -> bool:
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    if context is None:
        return True
    try:
        context._jvm.java.util.regex.Pattern.compile(java)
    except Exception:  # noqa: BLE001  whatever Java says, it is no pattern
        return False
    return True

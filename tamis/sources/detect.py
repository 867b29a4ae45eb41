"""Which format a text is likely in, from its first lines."""

from __future__ import annotations

import re

#: Formats of whole documents, with the confidence of each sign of them.
JSON, JSON_ARRAY, YAML, TOML, CSV, LOGFMT, TEXT = "json", "json_array", "yaml", "toml", "csv", "logfmt", "text"
LEAST_CONFIDENCE = 0.5
#: Characters with the Unicode property White_Space.
BLANKS = "\t-\r \x85\xa0  -     　"
_WORDS = re.compile(f"[^{BLANKS}]+")
_OUTER = re.compile(f"^[{BLANKS}]+|[{BLANKS}]+\\Z")


def words(line: str) -> list[str]:
    return _WORDS.findall(line)


def trim(text: str) -> str:
    return _OUTER.sub("", text)


def lines(text: str) -> list[str]:
    """Lines without their ends, which are a line feed after an optional carriage return."""
    found = text.split("\n")
    last = found.pop()
    found = [x[:-1] if x.endswith("\r") else x for x in found]
    return [*found, last] if last else found


def detect(text: str) -> list[tuple[str, float]]:
    """Candidates by falling confidence; plain text comes last, always."""
    start = re.sub(f"^[{BLANKS}]+", "", text[:100])
    found: list[tuple[str, float]] = []
    if start.startswith("{"):
        found.append((JSON, 0.9))
    if start.startswith("["):
        found.append((JSON_ARRAY, 0.9))
    if start.startswith("---"):
        found.append((YAML, 0.95))
    head = lines(text[: _first_lines(text, 10)])
    if likely_toml(head):
        found.append((TOML, 0.8))
    if not start.startswith("---") and (re.sub(f"^[{BLANKS}]+", "", text[:4096]).startswith("---") or likely_yaml(head)):
        found.append((YAML, 0.7))
    if likely_csv(head[:5]):
        found.append((CSV, 0.6))
    if likely_logfmt(head[:5]):
        found.append((LOGFMT, 0.5))
    found.append((TEXT, 0.1))
    return sorted(found, key=lambda f: -f[1])


def _first_lines(text: str, n: int) -> int:
    at = 0
    for _ in range(n):
        at = text.find("\n", at) + 1
        if not at:
            return len(text)
    return at


#: What speaks for a format on a line (as it is, and trimmed) that is neither blank nor a comment, and how much.
SIGNS = {
    TOML: (
        (2, lambda raw, line: " = " in line and line[0] != '"'),
        (3, lambda raw, line: line[0] == "[" and line[-1] == "]" and ":" not in line),
        (3, lambda raw, line: line[:2] == "[[" and line[-2:] == "]]"),
    ),
    YAML: (
        (1, lambda raw, line: ": " in line and line[0] != '"' and " = " not in line),
        (1, lambda raw, line: line[:2] == "- "),
        (2, lambda raw, line: raw[:2] == "  " and (": " in raw or line[:2] == "- ")),
    ),
}


def _signs(fmt: str, head: list[str]) -> int:
    told = [(raw, line) for raw in head if (line := trim(raw)) and line[0] != "#"]
    return sum(weight for weight, holds in SIGNS[fmt] for raw, line in told if holds(raw, line))


def likely_toml(head: list[str]) -> bool:
    return _signs(TOML, head) >= 2


def likely_yaml(head: list[str]) -> bool:
    return _signs(YAML, head) >= 2


def likely_csv(head: list[str]) -> bool:
    counts = [line.count(",") for line in head if trim(line)]
    return any(counts) and len(set(counts)) == 1


def likely_logfmt(head: list[str]) -> bool:
    for line in head:
        parts = words(line)
        pairs = sum("=" in p and not p.startswith("=") and not p.endswith("=") for p in parts)
        if parts and pairs / len(parts) > 0.5:
            return True
    return False


def compatible(found: str, forced: str) -> bool:
    """Whether a candidate stays under a forced format; objects and arrays of JSON are one format."""
    return found == forced or {found, forced} == {JSON, JSON_ARRAY}

"""URL filters: a trie over reversed host labels, then path segments, with longest-match precedence."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rules up to which the trie is broadcast (some hundred bytes a rule); longer lists belong in several calls by host suffix.
MOST_RULES = 1_000_000
#: A-Z only, as hosts are compared.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or a url without ``://``."""
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    if slash < 0:
        return rest[:end].translate(LOWER), ""
    return rest[:slash].translate(LOWER), rest[slash:end]


class Node:
    __slots__ = ("labels", "paths")

    def __init__(self):
        self.labels: dict[str, Node] = {}
        self.paths: Paths | None = None


class Paths:
    """Path segments below one host: a rule ends at a node, or inside the segment that follows it."""

    __slots__ = ("segments", "verdict", "rule", "inside")

    def __init__(self):
        self.segments: dict[str, Paths] = {}
        self.verdict: str | None = None
        self.rule = ""
        self.inside: dict[str, tuple[str, str]] = {}


class Trie:
    """Rules as (verdict, rule); a rule is a host and the start of a path, such as ``example.com/en/``.

    The longest match wins: the most host labels first, then the longest path. Of two entries for the same host
    and path, block wins.
    """

    def __init__(self, rules: list[tuple[str, str]]):
        self.root = Node()
        for verdict, rule in sorted(rules):  # allow before block, so that block stays
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(LOWER).split(".")):
                node = node.labels.setdefault(label, Node())
            at = node.paths = node.paths or Paths()
            *whole, last = (slash + path).split("/")
            for segment in whole:
                at = at.segments.setdefault(segment, Paths())
            if last:
                at.inside[last] = (verdict, rule)
            else:
                at.verdict, at.rule = verdict, rule

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest match, or nulls."""
        best: tuple[str | None, str | None] = (None, None)
        node: Node | None = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            at = node.paths
            for k, segment in enumerate(segments):
                if at is None:
                    break
                if at.verdict is not None:
                    best = at.rule, at.verdict
                if at.inside and segment:
                    for n in range(1, len(segment) + 1):
                        if (found := at.inside.get(segment[:n])) is not None:
                            best = found[1], found[0]
                at = at.segments.get(segment) if k < len(segments) - 1 else None
        return best


def judge(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row's url; narrow, with no shuffle.

    rules: (allow or block, rule), at most MOST_RULES, whose trie goes to every task. A rule fits its host and
    all subdomains of it where the url's path starts with the rule's. Urls that no rule fits get default and a
    null rule, among them null urls and urls without ``://``, whose host and path are empty. Ports and user
    names count as part of the host. Null ids and repeated rows come back as they are.
    """
    from tamis.llm.common import only

    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; a broadcast trie takes at most {MOST_RULES}")
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))
    schema = T.StructType([T.StructField("page_id", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict"))])

    def judged(batches):
        for batch in batches:
            found = []
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                rule, verdict = trie.value.find(host, path)
                found.append((host, path, rule, verdict or default))
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=schema.names)

    return only(pages, ("page_id", "bigint"), ("url", "string")).mapInArrow(judged, schema)

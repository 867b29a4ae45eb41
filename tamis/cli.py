"""Command line: ``python -m tamis.cli [EXPRESSION] [TEMPLATE] [-f FILE]... [--json | --yaml | ...]``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from tamis.plans.parser import ExpressionError

FORMATS = ("json", "yaml", "csv", "toml", "logfmt", "text")

EXAMPLES = """\
Select a field:          name          user.email      items.0      "field name"
Filter:                  age > 25      name == "Alice" && active?      !(role ~ "admin")
                         email ~= /@example\\.com$/i   name ^= "A"     file $= ".txt"
Render:                  [${name} is ${age}]     {Hello ${name}!}     $name     ${0}
                         ${active?yes:no}
Filter and render:       age > 25 [${name}: ${email}]
Columns of CSV:          field_0   ${1}   or the header's names in lower case
Words of text:           word_0 == "ERROR" {${word_1}}
"""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tamis", description="Select, filter and format records of JSON, YAML, TOML, CSV, logfmt and plain text.")
    p.add_argument("expression", nargs="?", help="field, filter, template, or filter and template")
    p.add_argument("template", nargs="?", help="template, if apart from the filter")
    p.add_argument("-f", "--file", action="append", default=[], help="input file, '-' for standard input; may be given again")
    p.add_argument("--examples", action="store_true", help="show examples and exit")
    for name in FORMATS:
        p.add_argument(f"--{name}", action="store_true", help=f"take the input for {name}")
    p.add_argument("-V", "--version", action="version", version="tamis 0.1")
    return p


def main(args: list[str] | None = None, spark=None, stdin=None, stdout=None, stderr=None) -> int:
    stdout, stderr = stdout or sys.stdout, stderr or sys.stderr
    given = parser().parse_args(args)
    if given.examples:
        stdout.write(EXAMPLES)
        return 0
    from tamis import api
    from tamis.plans.parser import compile_expression

    try:
        if given.expression is not None:
            compile_expression(given.expression, given.template)
    except ExpressionError as e:
        stderr.write(f"Error parsing expression: {e}\n")
        return 1
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("tamis").getOrCreate()
    forced = next((f for f in FORMATS if getattr(given, f)), None)
    for source in given.file or ["-"]:
        try:
            if source == "-":
                found = api.run_texts(spark, [(stdin or sys.stdin).read()], given.expression, given.template, forced)
            else:
                with open(source, encoding="utf-8"):
                    pass
                found = api.run_files(spark, [Path(source).resolve().as_uri()], given.expression, given.template, forced)
        except OSError as e:
            stderr.write(f"Error: cannot open file '{source}': {e}\n")
            return 1
        try:
            printed = found.collect()
        except api.BrokenFirstLine as e:
            stderr.write(f"Error processing stream from '{source}': {e}\n")
            return 1
        stdout.write("".join(f"{v}\n" for v in printed))
        for p in found.problems.orderBy("source", "at").collect():
            stderr.write(f"Warning: Failed to parse line {p['at']}: {p['message']}\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())

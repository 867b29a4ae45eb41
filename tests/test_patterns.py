"""Patterns of the source dialect: what they find, and which are plain text."""

import pytest
from pyspark.sql import functions as F

from tamis.functions.regex import search
from tamis.functions.text import number_text, number_words, parse_number, parsed
from tamis.operators.cells import matches
from tamis.plans.ast import Regex

#: (pattern, flags, text, whether it is found)
FOUND = [
    ("b", "", "abc", True), ("^b", "", "abc", False), ("c$", "", "abc", True), ("c$", "", "abc\n", False), ("^b", "m", "a\nb", True), ("a$", "m", "a\nb", True),
    ("a.b", "", "a\rb", True), ("a.b", "", "a\nb", False), ("a.b", "s", "a\nb", True), ("É", "i", "é", True), ("\\d", "", "٣", True), ("\\w+", "", "é", True), ("a b", "x", "a b", True), ("a b", "x", "ab", False),
    ("(?P<n>a)+c", "", "aac", True), ("(?<first_name>a)b", "", "ab", True), ("(?i)A", "", "a", True), ("(?i:A)b", "", "aB", False), ("[[:alpha:]]+1", "", "x1", True), ("[[:^digit:]]", "", "12", False), ("[]a]", "", "]", True),
    ("[^]]", "", "]", False), ("a{2}", "", "aa", True), ("a{2,}?", "", "a", False), ("a**", "", "", True), ("(ab)+*c", "", "c", True), ("\\x41\\u{42}", "", "AB", True), ("\\v", "", "\x0b", True), ("\\p{Greek}", "", "α", True),
    ("\\pL", "", "1", False), ("[a-c&&[^b]]", "", "b", False), ("\\.", "", ".", True), ("a|", "", "", True), ("", "", "", True),
]
#: Patterns that the source dialect refuses.
PLAIN = ["[bad", "(?=a)", "(?!a)", "(?<=a)b", "(?<!a)b", "(a)\\1", "(?>a)", "*a", "a(", "a)", "\\Qa\\E", "\\h", "\\G", "\\Z", "\\k<n>", "(?P=n)", "[[:nope:]]", "a\\", "{2}", "\\c", "[\\b]"]


def test_found(spark):
    df = spark.createDataFrame([(t,) for _, _, t, _ in FOUND], "t string").coalesce(1)
    got = df.select(*[matches(F.col("t"), Regex(p, f)).alias(str(i)) for i, (p, f, _, _) in enumerate(FOUND)]).collect()
    texts = [t for _, _, t, _ in FOUND]
    for i, (p, f, t, want) in enumerate(FOUND):
        assert search(p, f).java is not None, p
        assert got[texts.index(t)][str(i)] == want, (p, f, t)


@pytest.mark.parametrize("pattern", PLAIN)
def test_refused_patterns_are_plain_text(spark, pattern):
    how = search(pattern, "i")
    assert how.java is None and how.plain == pattern and how.fold
    df = spark.createDataFrame([(f"x{pattern.upper()}y",)], "t string")
    assert df.select(matches(F.col("t"), Regex(pattern, "i"))).first()[0] is True


def test_numbers_as_text(spark):
    xs = [0.0, 1.0, 25.5, 1e15, 1e16, 1e20, 1e-5, 1e-6, 1.5e-7, 0.0001, 123456.789, 12345678.9, -2.5, 1.23e21, 0.1, 100.0, 1.7976931348623157e308, 2.0**53, 0.00012345, 1e7, 12000000.0, -0.001, 0.1 + 0.2, -1e-7, float("nan"), float("inf")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r["t"] for r in df.orderBy("i").select(number_text(F.col("x")).alias("t")).collect()]
    assert got == [number_words(x) for x in xs]
    assert got[:10] == ["0.0", "1.0", "25.5", "1000000000000000.0", "1e16", "1e20", "0.00001", "1e-6", "1.5e-7", "0.0001"]


def test_text_as_numbers(spark):
    texts = ["5", " 5", "5d", "+5", ".5", "5.", "1e5", "inf", "-Infinity", "", "x", "0x10", "5f", "1e", "--1", "1_0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["x"] for r in df.orderBy("i").select(parsed(F.col("t")).alias("x")).collect()]
    assert got == [parse_number(t) for t in texts]

"""Functions for SQL texts: temporary functions of a session, whose bodies are expressions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text as T


def quoted(pattern: str) -> str:
    """A SQL string literal without escapes."""
    return "r'" + pattern.replace("'", "\\x27") + "'"


PARTS = f"transform(split(w, {quoted(T.CAMEL)}), p -> lower(p))"
#: Name and parameters, result type, expression.
FUNCTIONS = [
    ("word_tokens(content STRING)", "ARRAY<STRING>", f"regexp_extract_all(content, {quoted(T.WORD)}, 0)"),
    (
        "words_text(content STRING)",
        "ARRAY<STRING>",
        f"flatten(transform(regexp_extract_all(content, {quoted(T.WORD)}, 0), w -> IF(w RLIKE {quoted(T.HUMP)}, concat(array(lower(w)), {PARTS}), array(lower(w)))))",
    ),
    ("content_version(content STRING)", "STRING", "substring(sha2(content, 256), 1, 6)"),
    ("trigrams(line STRING)", "ARRAY<STRING>", f"array_distinct(regexp_extract_all(lower(line), {quoted('(?s)(?=(.{3}))')}, 1))"),
]


def register(spark: SparkSession) -> None:
    """Makes FUNCTIONS known to the session's SQL."""
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")

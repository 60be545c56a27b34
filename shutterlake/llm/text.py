"""Column helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Separators between words: space and the ASCII controls tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", -1), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other letter stays as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def total(values: Column, kind: str = "long") -> Column:
    """Sum of an array; 0 if it is empty."""
    return F.aggregate(values, F.lit(0).cast(kind), lambda acc, x: acc + x)


def count_of(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal in a text."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Scalar expressions; all are built-in, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_id(raw: Column) -> Column:
    """First run of digits, else the trimmed text; null stays null."""
    text = raw.cast("string")
    return F.coalesce(F.nullif(F.regexp_extract(text, r"\d+", 0), F.lit("")), F.trim(text))


def parse_decimal(raw: Column) -> Column:
    """Number with a decimal comma or point; null for anything else."""
    return F.replace(raw.cast("string"), F.lit(","), F.lit(".")).try_cast("double")


def clean_label(raw: Column) -> Column:
    """Trimmed text; missing stays missing instead of becoming a class of its own."""
    return F.nullif(F.trim(raw.cast("string")), F.lit(""))


def binarize(label: Column, positive: str) -> Column:
    return (label == positive).cast("int")


def is_shape(feature: Column) -> Column:
    return F.lower(feature).contains("shape")


def safe_name(name: Column) -> Column:
    """A feature name as part of a file name."""
    return F.translate(name, "/ ", "__")


def present(value: Column) -> Column:
    """1 where a criterion has a value over zero."""
    return (value > 0).cast("int")

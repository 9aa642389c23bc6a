"""Composition strings such as `6FA 4MO`: shares in tenths and species codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(value: Column) -> Column:
    """Upper case, white space collapsed, dashes alike."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(value), "[‐-―−]", "-"), "\\s+", " "))


def pairs(value: Column) -> Column:
    """array<struct<share, code>>, larger shares first, then by code."""
    shares, codes = (F.regexp_extract_all(value, F.lit(r"(\d{1,2})([A-Z]{2,4})"), F.lit(i)) for i in (1, 2))
    both = F.transform(F.arrays_zip(shares.alias("s"), codes.alias("c")), lambda x: F.struct((-x["s"].cast("int")).alias("m"), x["c"].alias("code")))
    return F.transform(F.array_sort(both), lambda x: F.struct((-x["m"]).alias("share"), x["code"].alias("code")))


def positive(value: Column) -> Column:
    """A number over 0, else null."""
    x = value.try_cast("double")
    return F.when(x > 0, x)

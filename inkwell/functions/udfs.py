"""Arrow functions for what Spark has no built-in for: Unicode forms and offsets of matches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def casefold(c) -> Column:
    return _casefold(c)


def nfc(c) -> Column:
    return _nfc(c)


def slug(c) -> Column:
    """A portable file name of at most 80 characters; null where nothing is left, null stays null."""
    v = F.regexp_replace(_nfkc(c), r"(?U)^\s+|\s+$", "")
    v = F.substring(F.regexp_replace(F.regexp_replace(v, r"(?U)[^\w.-]+", "-"), r"^[-.]+|[-.]+$", ""), 1, 80)
    return F.when(v != "", v)


def matches_of(pattern: str):
    """A function text -> array<struct<start, text, group>>: all matches with 0-based offsets."""
    schema = "array<struct<start:int,text:string,group:string>>"

    @F.pandas_udf(schema)
    def find(s: pd.Series) -> pd.Series:
        r = re.compile(pattern)
        return s.map(lambda v: [{"start": m.start(), "text": m.group(), "group": m.group(1) if r.groups else None} for m in r.finditer(v)], na_action="ignore")

    return find

"""Species ids and names as the tables spell them."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def absent(c: Column) -> Column:
    """True where a species column holds no value: null, empty, blank or ``nan``."""
    return c.isNull() | F.lower(F.trim(c)).isin("", "nan")


def id_number(c: Column) -> Column:
    """The number an id stands for (``0686``, ``686``, ``686.0``, `` 0686``), else null."""
    digits = F.regexp_extract(F.trim(c), r"^0*(\d+?)(?:\.0*)?$", 1)
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def four_digits(number: Column) -> Column:
    """The id in four digits; numbers beyond 9999 keep their length."""
    s = number.cast("string")
    return F.when(F.length(s) >= 4, s).otherwise(F.lpad(s, 4, "0"))


def base_name(path: Column) -> Column:
    """The part after the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def name_prefix(path: Column) -> Column:
    """The species number in front of a photograph's file name, else null."""
    return F.nullif(F.regexp_extract(F.trim(base_name(path)), r"^(\d+)\s*[-_]", 1), F.lit("")).try_cast("bigint")


def species_of(species_id: Column, path: Column) -> Column:
    """The id in four digits or, where absent, the prefix of the file name."""
    own = F.when(absent(species_id), F.lit(None)).otherwise(id_number(species_id))
    return four_digits(F.coalesce(own, name_prefix(path)))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def composed_name(c: Column) -> Column:
    """A name after Unicode composition, runs of white space as one blank, none at the ends."""
    one = F.trim(F.regexp_replace(_nfc(c), r"(?U)\s+", " "))
    return F.when(F.lower(one).isin("", "nan"), F.lit(None)).otherwise(one)

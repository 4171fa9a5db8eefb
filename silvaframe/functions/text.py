"""String functions on columns (FN-1 .. FN-13).  All are built-in expressions but for Unicode forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .species import base_name, composed_name  # noqa: F401  (FN-7 is composed_name)


def slashes(c: Column) -> Column:
    """FN-6: backslashes as slashes, null as empty."""
    return F.coalesce(F.translate(c, "\\", "/"), F.lit(""))


def stem(path: Column) -> Column:
    """File name without folders and without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def species_token(path: Column) -> Column:
    """FN-1: the stem up to the first hyphen or underscore; ``unknown`` if that is empty."""
    token = F.trim(F.regexp_extract(F.regexp_replace(base_name(path), r"\.[^.]+$", ""), r"^([^-_]*)", 1))
    return F.coalesce(F.nullif(token, F.lit("")), F.lit("unknown"))


def species_token_loose(name: Column) -> Column:
    """FN-2: whatever stands before the first hyphen, unchecked."""
    return F.regexp_extract(name, r"^([^-]*)", 1)


def species_token_strict(name: Column) -> Column:
    """FN-3: three to five digits before a hyphen, else null."""
    return F.nullif(F.regexp_extract(name, r"^(\d{3,5})-", 1), F.lit(""))


def leading_digits(name: Column) -> Column:
    """FN-4: the digits a name begins with, else null."""
    return F.nullif(F.regexp_extract(name, r"^(\d+)", 1), F.lit(""))


def safe_name(c: Column, prefix: str = "feat_", default: str = "unknown") -> Column:
    """FN-5: a column-safe name: other characters as one underscore, none at the ends."""
    s = F.regexp_replace(F.regexp_replace(c, "[^0-9A-Za-z_]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit(prefix), F.coalesce(F.nullif(s, F.lit("")), F.lit(default)))


@F.pandas_udf(T.StringType())
def _ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def slug(c: Column) -> Column:
    """FN-8: plain ASCII words joined by underscores."""
    s = F.regexp_replace(_ascii(c), r"[^A-Za-z0-9_\s-]", "")
    return F.regexp_replace(F.trim(s), r"\s+", "_")


def canonical_id(c: Column) -> Column:
    """FN-9: three to five digits padded to four, anything else as it is; blank and ``nan`` are null."""
    s = F.regexp_replace(F.trim(c), r"^(\d+)\.0*$", "$1")
    s = F.when(s.rlike(r"^\d{1,5}$"), F.when(F.length(s) < 4, F.lpad(s, 4, "0")).otherwise(s)).otherwise(s)
    return F.when(F.lower(s).isin("", "nan"), F.lit(None)).otherwise(s)


def short_id(c: Column) -> Column:
    """FN-9: an id without leading zeros, ``0`` if nothing is left."""
    s = F.regexp_replace(c, "^0+", "")
    return F.when(s == "", "0").otherwise(s)


def default_name(name: Column, species_id: Column) -> Column:
    """FN-10: a name, or one made of the id."""
    return F.coalesce(name, F.concat(F.lit("Especie_Desconocida_"), species_id))


def genus(name: Column) -> Column:
    """FN-11: the first word, ``?`` if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(F.trim(name), r"^(\S+)", 1), F.lit("")), F.lit("?"))


def binomial(name: Column) -> Column:
    """FN-11: the first two words, ``?`` if there are none."""
    two = F.regexp_replace(F.regexp_extract(F.trim(name), r"^(\S+(?:\s+\S+)?)", 1), r"\s+", " ")
    return F.coalesce(F.nullif(two, F.lit("")), F.lit("?"))


def task_parts(task: Column) -> Column:
    """FN-12: struct (species_id, rest): a leading digit token and what follows, else an empty id."""
    hit = task.rlike(r"^\s*\d+[\s_-]")
    return F.struct(F.when(hit, F.regexp_extract(task, r"^\s*(\d+)", 1)).otherwise(F.lit("")).alias("species_id"), F.when(hit, F.trim(F.regexp_extract(task, r"^\s*\d+[\s_-]+(.*)$", 1))).otherwise(F.trim(task)).alias("rest"))


def list_cell(c: Column) -> Column:
    """FN-13: a JSON list, or parts between ``;``, ``,`` or ``|`` without quotes and brackets; empty parts are dropped."""
    parts = F.transform(F.split(c, r"[;,|]"), lambda x: F.trim(F.regexp_replace(x, r"""[\[\]"']""", "")))
    return F.coalesce(F.from_json(F.when(F.trim(c).startswith("["), c), "array<string>"), F.filter(parts, lambda x: x != ""))

"""Text functions: native columns first, exact Unicode variants as Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: One token with the white space before it; joined, the first n give a prefix of the text.
TOKEN = r"\s*(?:[\p{L}\p{N}_]+|[^\s])"
FEATURE = r"[\p{L}\p{N}_]+"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def is_blank(x: Column) -> Column:
    return x.isNull() | ~x.rlike(r"(?U)\S")


def normalize_surface(x: Column) -> Column:
    """Surface form of an entity name: lower case, letters, digits and single spaces. Differs from the exact form
    only where NFKC or case folding do more than lower()."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def _surface(value: str | None) -> str | None:
    if value is None:
        return None
    folded = unicodedata.normalize("NFKC", value).casefold()
    return " ".join(re.sub(r"[^\w\s]", " ", folded).split())


@F.pandas_udf(StringType())
def normalize_surface_exact(x: pd.Series) -> pd.Series:
    return x.map(_surface)


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))


def token_count(x: Column) -> Column:
    return F.coalesce(F.regexp_count(x, F.lit(TOKEN)), F.lit(0)).cast("long")


def truncate_tokens(x: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_join(F.slice(tokens(x), 1, F.greatest(n, F.lit(0)).cast("int")), "")


def features(x: Column) -> Column:
    """Words and joined pairs of neighbours, as the hash embedding counts them."""
    words = F.regexp_extract_all(F.lower(x), F.lit(FEATURE), F.lit(0))
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit("::"), b)))
    return F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))


def normalize_question(x: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")), r"[?.! ]+$", "")


def merge_text(left: Column, right: Column, sep: str = " | ") -> Column:
    """Two texts as one: both, unless one is blank or they are the same. A text that was merged before is not taken apart."""
    return F.when(right == "", left).when((left == "") | (left == right), right).otherwise(F.concat(left, F.lit(sep), right))

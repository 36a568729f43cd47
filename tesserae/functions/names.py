"""Unicode name folding, in Arrow batches (Spark has no Unicode normalisation of its own)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def _folded(name: str | None) -> str | None:
    if name is None:
        return None
    bare = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.category(c).startswith("M")).lower()
    return " ".join("".join(c if c.isalpha() else " " for c in bare).split())


@F.pandas_udf(StringType())
def folded(names: pd.Series) -> pd.Series:
    """Without marks, in lower case, letters only, words parted by one space."""
    return names.map(_folded, na_action="ignore")


@F.pandas_udf(StringType())
def composed(names: pd.Series) -> pd.Series:
    """NFKC, lower case, white space collapsed: for equality of names as written."""
    return names.map(lambda n: " ".join(unicodedata.normalize("NFKC", n).lower().split()), na_action="ignore")


@F.pandas_udf(StringType())
def squashed(names: pd.Series) -> pd.Series:
    """NFKD, ASCII letters and digits only, lower case."""
    return names.map(lambda n: re.sub("[^a-z0-9]", "", unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode().lower()), na_action="ignore")


def tokens(folded_name: Column) -> Column:
    return F.when(folded_name == "", F.array().cast("array<string>")).otherwise(F.split(folded_name, " "))


def token_order(folded_name: Column) -> Column:
    """The words in order, joined: equal for reordered names."""
    return F.array_join(F.array_sort(tokens(folded_name)), " ")


@F.pandas_udf(ArrayType(StringType()))
def folded_each(names: pd.Series) -> pd.Series:
    """``folded`` of each element."""
    return names.map(lambda some: None if some is None else [_folded(n) for n in some])


#: How letters without a base letter and umlauts are commonly written out.
WRITTEN_OUT = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "å": "aa", "æ": "ae", "ø": "oe", "œ": "oe", "đ": "dj", "þ": "th", "ð": "dh", "ł": "l", "ı": "i"}
SHORT = {"ß": "s", "å": "a", "æ": "a", "ø": "o", "œ": "o", "đ": "d", "þ": "t", "ð": "d", "ł": "l", "ı": "i"}


def transliterations(name: Column) -> Column:
    """The spellings that a name takes under each scheme as a whole, without the name itself: two at most, none for null."""
    small = F.lower(name)

    def spelt(scheme: dict[str, str]) -> Column:
        out = small
        for letter, other in scheme.items():
            out = F.replace(out, F.lit(letter), F.lit(other))
        return out

    return F.coalesce(F.array_except(F.array(spelt(WRITTEN_OUT), spelt(SHORT)), F.array(small, F.lit(None).cast("string"))), F.array().cast("array<string>"))


def combinations(given: Column, family: Column, whole: Column, least: int = 5) -> Column:
    """Squashed forms under which a name may be listed: given and family name in both orders, and the whole name; forms
    of fewer than ``least`` letters and digits are left out, as are pairs of which one is missing."""
    both = (given != "") & (family != "")
    forms = F.array(squashed(F.when(both, F.concat(given, family))), squashed(F.when(both, F.concat(family, given))), squashed(whole))
    return F.array_sort(F.array_distinct(F.filter(forms, lambda x: F.char_length(x) >= least)))

"""Unicode normalization, the one step for which Spark has no built-in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Matches what NFKC leaves alone: ASCII, kana, kanji and the common ideographic marks.
STABLE = r"^[\x00-\x7F\x{3001}-\x{3003}\x{3005}-\x{3020}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{30FC}-\x{30FE}\x{4E00}-\x{9FFF}]*$"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _nfkc_strip(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).strip())


def nfkc(text: Column) -> Column:
    """NFKC; null stays null. Runs as one Arrow batch UDF."""
    return _nfkc(text)


def nfkc_strip(text: Column) -> Column:
    """NFKC, then all outer white space removed; null stays null."""
    return _nfkc_strip(text)

"""The three text functions that Spark lacks, as Arrow-batched functions on the standard library.

Rows that a cheap expression can decide should be filtered out before: Spark runs these for every row they see.
"""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def cmp_norm(values: pd.Series) -> pd.Series:
    """Comparison key: compatibility decomposition, lower case, runs of anything but a-z and 0-9 become one space; null is empty."""
    return values.fillna("").map(lambda v: re.sub(r"[^a-z0-9]+", " ", unicodedata.normalize("NFKD", v).lower()).strip())


def similarity(first: Column, second: Column, least: float = 0.0) -> Column:
    """difflib's ratio with its default heuristics; the order of the two texts matters. Null counts as empty.

    Where difflib's quick upper bounds are already below ``least`` the costly ratio is not computed and 0 returned.
    """

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> float:
            m = difflib.SequenceMatcher(None, x, y)
            return m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0

        return pd.Series([one(x, y) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype=float)

    return ratio(first, second)


@F.pandas_udf(T.DoubleType())
def longest_block_share(text: pd.Series, value: pd.Series) -> pd.Series:
    """Length of the longest common block as a share of the value's length."""

    def share(t: str, v: str) -> float:
        return difflib.SequenceMatcher(None, t, v).find_longest_match(0, len(t), 0, len(v)).size / max(1, len(v))

    return pd.Series([share(t, v) for t, v in zip(text.fillna(""), value.fillna(""), strict=True)], dtype=float)

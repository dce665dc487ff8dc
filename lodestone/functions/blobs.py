"""Compressed texts as bytes, for stores that keep them outside Parquet."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def gzipped(c: pd.Series) -> pd.Series:
    """The text's UTF-8 bytes by gzip at level 6 with no time, so that equal texts give equal bytes."""
    return c.map(lambda x: None if x is None else gzip.compress(x.encode(), 6, mtime=0))


@F.pandas_udf(T.StringType())
def gunzipped(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else gzip.decompress(x).decode())

"""Order-preserving numbers for doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType


@F.pandas_udf(LongType())
def _to_long(x: pd.Series) -> pd.Series:
    bits = (x.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.iinfo(np.int64).max, bits))


@F.pandas_udf(DoubleType())
def _to_double(x: pd.Series) -> pd.Series:
    n = x.to_numpy(np.int64)
    return pd.Series(np.where(n < 0, n ^ np.iinfo(np.int64).max, n).view(np.float64))


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def double_to_long(x: Column | str) -> Column:
    """Sorts as the doubles do; -0.0 is 0, NaN comes last, null is null (no null reaches the function, where it would be NaN)."""
    c = column(x).cast("double")
    return F.when(c.isNotNull(), _to_long(F.coalesce(c, F.lit(0.0))))


def long_to_double(n: Column | str) -> Column:
    """The double that ``double_to_long`` numbered; null is null (no null reaches the function, where it would widen all numbers)."""
    c = column(n).cast("long")
    return F.when(c.isNotNull(), _to_double(F.coalesce(c, F.lit(0).cast("long"))))

"""Row-level helpers on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """A filter that stays where it stands.

    An ordinary filter on a computed column is pushed below the projections that compute
    it, each time with the whole expression copied in; behind a long chain of cleaning
    steps that multiplies the work. A generator is a barrier: the condition is evaluated
    once, on the finished columns. Use it only for conditions on computed columns, never
    for those a scan could answer.
    """
    gate = F.explode(F.when(condition, F.array(F.lit(True))))
    return df.select("*", gate.alias("_keep")).drop("_keep")


def whole(array: Column | str) -> Column:
    """An array as a generator argument.

    For a bare column the optimizer adds a "not empty" filter below the generator and
    pushes it down to the scan together with a copy of everything that computes the array,
    which would then run twice. It adds none for an expression.
    """
    return F.slice(F.col(array) if isinstance(array, str) else array, 1, 2**31 - 1)


def posexplode(array: Column | str) -> Column:
    return F.posexplode(whole(array))


def inline(array: Column | str) -> Column:
    return F.inline(whole(array))

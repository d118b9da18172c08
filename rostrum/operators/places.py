"""Places, ranks and exact percentiles of all rows of a table, without a window that puts them in one task.

Rows are sorted by ranges that Spark samples, so a place is the rows of the ranges
before plus the number within its own range. Ties of the whole order are dealt out
by a running number, so that a value which a third of the rows have is no single
range. The sorted rows are written once in the shared folder: a lost executor
doesn't sort anew, and what is counted is what is read. Only counts of ranges
reach the driver, one for each partition of the sort.

Nulls come where the order says. An empty table stays empty. Columns may have any name.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.session import checkpointed, free

#: The running number of Spark: the partition above these bits, the row in it below.
ROW_BITS = 33


def placed(df: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """Adds ``name``: 1, 2, 3 ... over all rows in this order; rows that tie in it get different places, in any order."""
    row, at = free(df, "__row"), free(df, "__at")
    ranged = df.withColumn(row, F.monotonically_increasing_id()).orderBy(*order, row).drop(row)
    held = checkpointed(ranged.withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, ROW_BITS)
    sizes = dict(held.groupBy(part.alias("part")).count().collect())
    before = [0, *accumulate(sizes.get(k, 0) for k in range(max(sizes, default=-1) + 1))]
    place = F.element_at(F.lit(before), (part + 1).cast("int")) + F.col(at) - F.shiftleft(part, ROW_BITS) + 1
    return held.withColumn(name, place.cast("long")).drop(at)


def ranked(df: DataFrame, value: str, names: tuple[str, str] = ("lowest", "highest"), descending: bool = False) -> DataFrame:
    """Adds the first and the last place of the rows that have the same ``value``.

    Competition ranks are the first of these, fractional ranks their mean. Values are
    counted before they are ordered, so that the order has one row for each value.
    """
    held, first, last = free(df, "__held"), *names
    counts = df.groupBy(F.col(value).alias(held)).agg(F.count("*").alias(first))
    key = F.col(held).desc_nulls_last() if descending else F.col(held).asc_nulls_first()
    found = running(counts, [key], first, last).withColumn(first, F.col(last) - F.col(first) + 1)
    joined = df.join(found, df[value].eqNullSafe(found[held]))
    return joined.drop(held)


def running(df: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over this row and all before it, in an order that has no ties."""
    at, part = free(df, "__at"), free(df, "__part")
    held = checkpointed(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, ROW_BITS))
    sums = dict(held.groupBy(part).agg(F.sum(value)).collect())
    before = [0, *accumulate(sums.get(k) or 0 for k in range(max(sums, default=-1) + 1))]
    own = F.sum(value).over(Window.partitionBy(part).orderBy(at))
    return held.withColumn(name, own + F.element_at(F.lit(before), (F.col(part) + 1).cast("int"))).drop(at, part)


def percentiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles with linear interpolation between neighbours, of all values that aren't null; null if there are none."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    found = running(counted, ["value"], "n", "upto")
    total = found.agg(F.max("upto")).first()[0]
    if total is None:
        return [None] * len(shares)
    spots = [share * (total - 1) for share in shares]
    wanted = sorted({w for spot in spots for w in (int(spot), min(int(spot) + 1, total - 1))})
    holds = F.explode(F.filter(F.lit(wanted), lambda w: (w < F.col("upto")) & (w >= F.col("upto") - F.col("n"))))
    values = {r.at: r.value for r in found.select(holds.alias("at"), "value").collect()}
    return [values[int(s)] + (s - int(s)) * (values[min(int(s) + 1, total - 1)] - values[int(s)]) for s in spots]


def nth_of(df: DataFrame, value: str, part: int, of: int):
    """The value at place n * part // of, counted from 0, among all n rows in order, nulls first; None without rows."""
    found = running(df.groupBy(value).agg(F.count("*").alias("__n")), [F.col(value).asc_nulls_first()], "__n", "__upto")
    total = found.agg(F.max("__upto")).first()[0] or 0
    spot = total * part // of
    row = found.filter((F.col("__upto") > spot) & (F.col("__upto") - F.col("__n") <= spot)).first()
    return None if row is None else row[value]

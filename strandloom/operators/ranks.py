"""Running counts and sums in a total order without a window over a whole group, and values by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.session import materialize


def running_sum(df: DataFrame, group: str, *order: str, value: str | None = None, column: str = "before") -> DataFrame:
    """The sum of ``value`` (without one: the number of rows) over the rows before each row in its group's order.

    Range partitioning sorts the rows by group and order, so that a group of any size is cut over many tasks; the sums
    of each partition's groups, a row each, give the next partitions' start.
    """
    amount = F.lit(1) if value is None else F.col(value)
    parts = materialize(df.repartitionByRange(group, *order).withColumn("__part", F.spark_partition_id()), "running")
    sums = parts.groupBy(group, "__part").agg(F.sum(amount).alias("__sum"))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(group).alias("__group"), F.col("__part").alias("__of"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(amount).over(within), F.lit(0))
    rows = parts.withColumn("__own", own)
    rows = rows.join(starts, (F.col("__part") == F.col("__of")) & F.col(group).eqNullSafe(F.col("__group")))
    return rows.withColumn(column, F.col("__start") + F.col("__own")).drop("__part", "__of", "__group", "__start", "__own")


PART = 10_000


def lists_in_parts(rows: DataFrame, keys: list[str], value: str, names: str, size: int = PART) -> DataFrame:
    """(keys, part, names): each key's distinct values in order, in lists of at most ``size``, so that a key of very many is many rows."""
    distinct = rows.select(F.struct(*keys).alias("__key"), value).distinct()
    ranked = running_sum(distinct, "__key", value, column="__nth")
    lists = ranked.groupBy("__key", F.expr(f"__nth div {size}").cast("int").alias("part")).agg(F.array_sort(F.collect_list(value)).alias(names))
    return lists.select("__key.*", "part", names)


SORTED = 10_000


def value_at(df: DataFrame, column: str, rank: int, sorted_rows: int = SORTED) -> float | int | None:
    """The value of ``rank`` (from 0) in ``column``'s order, nulls left out; None beyond its end.

    Each pass brackets the rank by approximate quantiles and counts what lies below and within, until the bracket is one value or
    holds at most ``sorted_rows`` rows. Only counts and those rows come to one task, however many different values there are.
    """
    rows = df.select(F.col(column).alias("v")).where("v IS NOT NULL")
    n = rows.count()
    if not 0 <= rank < n:
        return None
    while n > sorted_rows:
        share = [max(0.0, (rank - n * 0.001) / n), min(1.0, (rank + n * 0.001) / n)]
        low, high = rows.agg(F.percentile_approx("v", share, 20_000).alias("q")).first()["q"]
        told = rows.agg(F.count_if(F.col("v") < low).alias("below"), F.count_if(F.col("v") == low).alias("at_low"), F.count_if(F.col("v").between(low, high)).alias("within"), F.count_if(F.col("v") > high).alias("above")).first()
        if told["below"] <= rank < told["below"] + told["at_low"]:
            return low
        if rank < told["below"]:
            rows, n = rows.where(F.col("v") < low), told["below"]
        elif rank < told["below"] + told["within"]:
            rows, rank, n = rows.where((F.col("v") > low) & (F.col("v") <= high)), rank - told["below"] - told["at_low"], told["within"] - told["at_low"]
        else:
            rows, rank, n = rows.where(F.col("v") > high), rank - told["below"] - told["within"], told["above"]
    return rows.orderBy("v").limit(rank + 1).agg(F.max("v")).first()[0]


def exact_median(df: DataFrame, column: str, sorted_rows: int = SORTED) -> float | None:
    """The median of a column: the middle value, or the mean of both middle ones; None without values."""
    n = df.where(F.col(column).isNotNull()).count()
    if not n:
        return None
    low = value_at(df, column, (n - 1) // 2, sorted_rows)
    return float(low) if n % 2 else (low + value_at(df, column, n // 2, sorted_rows)) / 2

"""Windows over groups of any size. Rows are dealt by ranges of group and order, so a group that holds a third of all rows is
many parts; each part works on its own rows, and what it needs of the parts before it is a row for each part and group, or
a few of their last rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .storage import materialize


def dealt(rows: DataFrame, group: str, order: list) -> DataFrame:
    """rows with _part, written once so that all later uses see the same parts."""
    return materialize(rows.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()), "dealt")


def running(rows: DataFrame, group: str, order: list, value: Column, name: str) -> DataFrame:
    """rows with the running sum of a value within each group, in order, the row's own included. Null is a group."""
    parts = dealt(rows.withColumn("_value", value), group, order)
    own = parts.withColumn("_own", F.sum("_value").over(W.partitionBy("_part", group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    sums = parts.groupBy("_part", group).agg(F.sum("_value").alias("_sum"))  # a row for each part and group
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(F.col("_part").alias("_of"), F.col(group).alias("_in"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    both = own.join(base, (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_in")))
    return both.withColumn(name, F.col("_own") + F.col("_base")).drop("_part", "_own", "_base", "_of", "_in", "_value")


def row_numbers(rows: DataFrame, group: str, order: list, number: str) -> DataFrame:
    """Numbers rows from 1 within each group by the order columns."""
    return running(rows, group, order, F.lit(1), number)


def with_rows_before(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """rows with _part and _before = false; and copies with _before = true of the last n rows that stand before a part's
    first group in it. A window partitioned by _part and the group that looks at most n rows back sees, for the rows that
    are not copies, what it would see in the whole group."""
    parts = dealt(rows, group, order)
    back = W.partitionBy("_part", group).orderBy(*[F.desc(c) for c in order])
    tails = materialize(parts.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= n).drop("_back"), "tails")
    # the last rows of all parts, numbered in their group; of a group over many parts, n rows a part
    tails = tails.withColumn("_no", F.row_number().over(W.partitionBy(group).orderBy("_part", *order)))
    held = tails.groupBy(group, "_part").agg(F.max("_no").alias("_last"))
    wanted = held.withColumn("_seen", F.lag("_last").over(W.partitionBy(group).orderBy("_part"))).filter("_seen is not null")
    wanted = wanted.select(F.col(group).alias("_in"), F.col("_part").alias("_to"), F.explode(F.sequence(F.greatest(F.col("_seen") - n + 1, F.lit(1)), F.col("_seen"))).alias("_want"))
    copies = tails.join(wanted, F.col(group).eqNullSafe(F.col("_in")) & (F.col("_no") == F.col("_want")))
    copies = copies.withColumns({"_part": F.col("_to"), "_before": F.lit(True)}).select(*parts.columns, "_before")
    return parts.withColumn("_before", F.lit(False)).unionByName(copies)

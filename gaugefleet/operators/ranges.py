"""Order statistics and running values of very large groups, without bringing a group into one task.

A window over a group sorts the group in one task. Here a group's rows are dealt to cells of its order, each
a window of its own, and only one row per cell is brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A cell of a run's steps is so many step ids in a row.
CELL = 1 << 16
#: Cells of a value for each doubling of it, and of such a cell in turn.
_PER_DOUBLING, _WITHIN = 1 << 10, 1 << 16


def with_previous(rows: DataFrame, keys: list[str], at: str, value: Column, out: str, cell: Column | None = None) -> DataFrame:
    """Adds ``out``: the last ``value`` that isn't null of the rows before this one, by ``at``, within ``keys``.

    ``cell`` (by default ``CELL`` whole numbers of ``at`` in a row) never falls as ``at`` rises. Each cell is scanned by itself;
    what it ends with goes to the next through a table of one row per cell. So no window holds more than a cell's rows,
    or than a group's cells. ``keys`` are not null.
    """
    cell = F.floor(F.col(at) / CELL).cast("long") if cell is None else cell
    held = rows.withColumns({"__cell": cell, "__value": value})
    ends = held.groupBy(*keys, "__cell").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(at))).alias("__end"))
    earlier = lambda *k: Window.partitionBy(*k).rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*keys, "__cell", F.last("__end", True).over(earlier(*keys).orderBy("__cell")).alias("__before"))
    inside = held.withColumn("__inside", F.last("__value", True).over(earlier(*keys, "__cell").orderBy(at)))
    return inside.join(before, [*keys, "__cell"], "left").withColumn(out, F.coalesce("__inside", "__before")).drop("__cell", "__value", "__inside", "__before")


def nth(rows: DataFrame, keys: list[str], at: str, n: int, out: str, last: bool = False) -> DataFrame:
    """(keys, out): the ``n``-th smallest ``at`` of each group, or largest; groups with fewer rows have none. Tasks send on ``n`` rows of a group at most."""
    order = Window.partitionBy(*keys).orderBy(F.desc(at) if last else F.asc(at))
    return rows.select(*keys, at).withColumn("__n", F.row_number().over(order)).where(F.col("__n") == n).select(*keys, F.col(at).alias(out))


def medians(values: DataFrame, keys: list[str], value: str, out: str, upper: bool = False) -> DataFrame:
    """(keys, out): the exact median of the positive values of each group, the mean of the middle two, or the upper one if asked.

    Values are counted in cells of their logarithm; the cell that holds the middle is counted again in equal parts of
    its range, and only the values of one such part are ordered. Nulls and values that aren't positive don't count;
    groups without others have no row. ``keys`` are not null.
    """
    counts = values.where(F.col(value) > 0).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    counts = counts.withColumn("__a", F.floor(F.log2("__v") * _PER_DOUBLING).cast("long"))
    cells = counts.groupBy(*keys, "__a").agg(F.sum("__c").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    whole = Window.partitionBy(*keys)
    cells = cells.withColumns({"__until": F.sum("__c").over(whole.orderBy("__a")), "__all": F.sum("__c").over(whole)})
    low, high = F.floor((F.col("__all") + 1) / 2), F.floor(F.col("__all") / 2) + 1
    ranks = F.array(high) if upper else F.array(low, high)
    reached = (F.col("__rank") <= F.col("__until")) & (F.col("__rank") > F.col("__until") - F.col("__c"))
    inside = F.col("__rank") - F.col("__until") + F.col("__c")
    first = cells.withColumn("__rank", F.explode(F.array_distinct(ranks))).where(reached).select(*keys, "__a", "__lo", "__hi", F.col("__rank").alias("__which"), inside.alias("__rank"))

    part = F.when(F.col("__hi") > F.col("__lo"), F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * _WITHIN)).otherwise(0).cast("long")
    near = counts.join(first, [*keys, "__a"]).withColumn("__b", part)
    parts = near.groupBy(*keys, "__which", "__b").agg(F.sum("__c").alias("__c"), F.max("__rank").alias("__rank"))
    parts = parts.withColumn("__until", F.sum("__c").over(Window.partitionBy(*keys, "__which").orderBy("__b")))
    second = parts.where(reached).select(*keys, "__which", "__b", inside.alias("__left"))
    last = near.join(second, [*keys, "__which", "__b"]).withColumn("__until", F.sum("__c").over(Window.partitionBy(*keys, "__which").orderBy("__v")))
    middle = last.where((F.col("__left") <= F.col("__until")) & (F.col("__left") > F.col("__until") - F.col("__c")))
    return middle.groupBy(*keys).agg(F.avg("__v").alias(out))

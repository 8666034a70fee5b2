"""Places in a global order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramma.storage import written


def numbered(rows: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """``rows`` with each row's place from 1 in the order: its place in its sorted partition after those of the partitions before.

    Rows that the order does not tell apart take some order among themselves. The sort is written once, so that a task
    that runs again numbers alike; what is in one place is a row a partition.
    """
    sorted_rows = written(rows.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__m", 33)
    sizes = sorted_rows.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__p", before.alias("__before"))
    out = sorted_rows.join(F.broadcast(sizes), part == F.col("__p"))
    return out.withColumn(name, F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__m", "__p", "__before")


def running(rows: DataFrame, group: str, order: list[Column | str], sums: dict[str, str], position: str) -> DataFrame:
    """``rows`` with each row's place from 0 in its group, and for each of ``sums`` (new column: column) the sum over the rows before it.

    A group may be as large as the table: rows are sorted by group and order into ranges, summed up within each range,
    and moved on by what the group has in the ranges before. A null group is a group, if its column is text.
    """
    g = F.coalesce(F.col(group), F.lit(""))
    sorted_rows = written(rows.orderBy(group, *order).withColumn("__m", F.monotonically_increasing_id()), "running")
    part = sorted_rows.withColumn("__p", F.shiftright("__m", 33)).withColumn("__g", g)
    here = Window.partitionBy("__g", "__p").orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(here), F.lit(0))
    part = part.withColumns({f"__s_{n}": before(F.coalesce(F.col(c), F.lit(0))) for n, c in {**sums, position: None}.items() if c} | {f"__s_{position}": before(F.lit(1))})
    totals = sorted_rows.groupBy(g.alias("__g"), F.shiftright("__m", 33).alias("__p")).agg(F.count("*").alias(f"__t_{position}"), *(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"__t_{n}") for n, c in sums.items()))
    ranges = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    names = [position, *sums]
    totals = totals.select("__g", "__p", *(F.coalesce(F.sum(f"__t_{n}").over(ranges), F.lit(0)).alias(f"__b_{n}") for n in names))
    out = part.join(totals, ["__g", "__p"])
    return out.select(*rows.columns, *((F.col(f"__s_{n}") + F.col(f"__b_{n}")).cast("long").alias(n) for n in names))

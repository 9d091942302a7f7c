"""Places in an order over whole tables or whole classes, without a task that sees more than its share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.corpora import saved, spread


def numbered(df: DataFrame, *order: Column | str, name: str = "position", tasks: int = 0) -> DataFrame:
    """df with name (long): the place of each row in the order, gapless from 0.

    Rows are dealt to tasks by ranges of the order and sorted there. A row's place is its place in the range plus the rows of the
    ranges before it, of which there are as many as shuffle partitions. Rows that are equal in all of order have
    any places among themselves, so order should hold whatever tells rows apart. df is evaluated twice (ranges are sampled first).
    There are as many ranges as tasks, if given, else as shuffle partitions.
    """
    at, part, before = (f"_{name}_{x}" for x in ("at", "range", "before"))
    dealt = saved((df.repartitionByRange(tasks, *order) if tasks else df.repartitionByRange(*order)).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    total, starts = 0, []
    for row in dealt.groupBy(F.shiftright(at, 33).alias(part)).count().orderBy(part).collect():
        starts.append((row[part], total))
        total += row["count"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, f"{part} long, {before} long"))
    placed = dealt.withColumn(part, F.shiftright(at, 33)).join(offsets, part)
    return placed.select(*df.columns, (F.col(at).bitwiseAND((1 << 33) - 1) + F.col(before)).alias(name))


def numbered_in(df: DataFrame, by: str, *order: Column | str, name: str = "pos", first: int = 1, many: bool = False) -> DataFrame:
    """df with name (int): the place of each row in its class by, from first, however many rows the class has.

    With many, there may be as many classes as rows, and what is known of them is never broadcast.
    """
    placed = saved(numbered(df, by, *order, name=f"_{name}_all"))
    starts = placed.groupBy(F.col(by).alias(f"_{name}_by")).agg(F.min(f"_{name}_all").alias(f"_{name}_first"))
    return placed.join(spread(starts) if many else starts, F.col(by).eqNullSafe(F.col(f"_{name}_by"))).select(*df.columns, (F.col(f"_{name}_all") - F.col(f"_{name}_first") + first).cast("int").alias(name))

"""How rows are dealt out, and columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks a core for work that is long for each row.
TASKS_A_CORE = 3
#: Rows of a task that sorts them for a join or an aggregation.
TASK_ROWS = 1 << 19


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """The rows dealt out by these columns to a few tasks a core, if they come in fewer.

    A small table comes as one task or two however many rows it has; what is
    then parsed or matched in each row would run there.
    """
    n = TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n, *by) if rows.rdd.getNumPartitions() < n else rows


def tasks_for(spark: SparkSession, *counts: int) -> int:
    """Tasks for tables of so many rows: of the largest each gets TASK_ROWS, whatever the session's number of partitions."""
    return max(spark.sparkContext.defaultParallelism, -(-max(counts) // TASK_ROWS))


def dealt(rows: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    """The rows dealt out by these columns to so many tasks; as they come without a number.

    Joins and aggregations by the same columns go on there. Without it Spark
    joins shuffled partitions by their compressed size, and never has more of
    them than the session says, so the rows of a task grow with the table.
    """
    return rows if tasks is None else rows.repartition(tasks, *by)


def once(rows: DataFrame, /, **columns: Column) -> DataFrame:
    """The rows with these columns (or others in their place), each computed once for a row.

    Without it a filter on a column, and every lambda that uses it, has the
    whole expression again. They are the output of a generator of one row, which
    expressions are not moved through.
    """
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.stack(F.lit(1), *columns.values()).alias(*columns))


def unbroadcast(rows: DataFrame) -> DataFrame:
    """The rows as a side of an equality join that is made by a shuffle.

    What is unfolded from a small file counts as no larger than the file when
    Spark plans, so it would be broadcast through the driver.
    """
    return rows.hint("merge")

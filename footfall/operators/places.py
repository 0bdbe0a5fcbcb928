"""Places of rows in a sorted table, without a window over the whole table.

Rows are range-partitioned and sorted, each partition's row count is taken, and a row's place is the sum of
the counts before its partition plus its number inside it. The only thing on the driver is one count a
partition. Rows that tie in the order are spread and numbered by a hash of the whole row, so a value that
a third of all rows share does not meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.session import save_once

_ROW_BITS = 33            # of monotonically_increasing_id: the row's number inside its partition


def numbered_rows(df: DataFrame) -> DataFrame:
    """Rows with ``_part`` and ``_at``: their partition and their number in it, from 0."""
    return (df.withColumn("_part", F.spark_partition_id())
            .withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << _ROW_BITS) - 1)))


def with_places(df: DataFrame, order: Sequence[str], out_col: str = "place", partitions: int | None = None) -> DataFrame:
    """``df`` with each row's place (from 1) in the order of the columns ``order`` (ascending, NULLs first).

    The sorted rows are written once in the shared folder: counts and places are taken from the same
    partitions, also when a task is run again."""
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    by = [*[F.col(c).asc_nulls_first() for c in order], F.xxhash64(*df.columns).asc()]
    sorted_rows = save_once(numbered_rows(df.repartitionByRange(n, *by).sortWithinPartitions(*by)), "places")
    counts = sorted(map(tuple, sorted_rows.groupBy("_part").count().collect()))
    before, total = [], 0
    for part, size in counts:
        before.append((part, total))
        total += size
    if not before:
        return sorted_rows.drop("_part", "_at").withColumn(out_col, F.lit(0).cast("bigint"))
    table = spark.createDataFrame(before, "_part INT, _before BIGINT")
    return (sorted_rows.join(table, "_part").withColumn(out_col, F.col("_before") + F.col("_at") + 1)
            .select(*df.columns, out_col))

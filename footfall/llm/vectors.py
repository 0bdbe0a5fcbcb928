"""Vector columns: which rows take part, and their matrices inside tasks.

A row takes part if its vector is not null, is not empty, holds no null and no non-finite entry, and has
the table's most frequent length (of equally frequent ones the longest).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id long, v array<double>) of the rows whose vector is whole and finite."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)


def of_one_length(df: DataFrame, chosen: Column | None = None) -> tuple[DataFrame, int, int, int]:
    """(rows of the most frequent length, that length, their number, how many of them ``chosen`` marks);
    length 0 if there are no rows."""
    marked = F.count_if(chosen) if chosen is not None else F.lit(0)
    best = (df.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), marked.alias("m"))
            .orderBy(F.desc("n"), F.desc("d")).limit(1).collect())
    if not best:
        return df, 0, 0, 0
    d, n, m = best[0]
    return df.where(F.size("v") == d), d, n, m


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a list column of one length, without nulls, as a matrix."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), d)


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, which are null); a null reads as the greatest long."""
    return column.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)

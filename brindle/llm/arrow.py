"""Small helpers for operators that run on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import spread


def named(df: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """``df`` with only the id and text columns, under the fixed names id, t0, t1, ...

    All other columns, whatever their names, are left behind, so names cannot clash and the scan reads only these.
    """
    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), *[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(text_cols)])


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df`` through ``run``, one call per partition; inputs of fewer splits than cores are spread first."""
    return spread(df).mapInArrow(run, schema)

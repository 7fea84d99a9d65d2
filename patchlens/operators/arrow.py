"""Python functions on single values as columns, in Arrow batches; only the inputs travel to Python."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows that are Python objects at once.
ROWS = 64


def laid(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as they are, each computed once: the planner does not put their expressions where they are used.

    Filters and columns behind it see values; merged with what makes them, a text would be made anew at every use.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def computed(df: DataFrame, name: str, kind: T.DataType | str, function: Callable[..., Any], *inputs: Column) -> DataFrame:
    """df with one more column: a Python function of the inputs of each row."""
    spark_type = kind if isinstance(kind, T.DataType) else T.DataType.fromDDL(kind)
    arrow = to_arrow_type(spark_type)

    def run(*columns: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(columns[0]), ROWS):
            values = [function(*x) for x in zip(*(c.slice(at, ROWS).to_pylist() for c in columns), strict=True)]
            parts.append(pa.array(values, arrow))
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    # inputs become columns of rows made for them, behind which the planner leaves them: merged into the call, expressions
    # with nested lambdas are not evaluated ahead of it
    given = F.inline(F.array(F.struct(*(c.alias(f"_in{i}") for i, c in enumerate(inputs)))))
    laid = df.select("*", given)
    value = F.arrow_udf(run, spark_type)(*(F.col(f"_in{i}") for i in range(len(inputs))))
    return laid.select(*(F.col(f"`{c}`") for c in df.columns), value.alias(name))

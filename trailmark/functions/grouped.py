"""Functions of one's own on columns, groups of rows and frames of groups.

Expressions stay in the JVM: transform_groups and filter_groups are windows.  Python functions run on Arrow batches; a
group is one pandas frame, so it must fit into a task (a track or a scene, not a recording).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def group(*keys: str) -> WindowSpec:
    return W.partitionBy(*keys)


def transform_groups(df: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """New columns from window expressions over group(); rows stay."""
    return df.withColumns(columns)


def filter_groups(df: DataFrame, keys: list[str], predicate: Column) -> DataFrame:
    """The groups for which an aggregate predicate holds."""
    kept = df.groupBy(*keys).agg(predicate.alias("_keep")).where("_keep").drop("_keep")
    return df.join(kept, keys, "left_semi")


def scalar(df: DataFrame, column: str, function: Callable[[pd.Series], pd.Series], name: str, kind: str) -> DataFrame:
    """A function of a column, on batches."""
    return df.withColumn(name, F.pandas_udf(function, kind)(F.col(column)))


def transform_with(df: DataFrame, keys: list[str], order: str, column: str, function: Callable[[pd.Series], pd.Series], name: str) -> DataFrame:
    """A function from a group's values, in order, to as many values."""
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])
    return df.groupBy(*keys).applyInPandas(lambda pdf: (s := pdf.sort_values(order, kind="stable")).assign(**{name: function(s[column])}), schema)


def apply_with(df: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function from a group's rows to any rows."""
    return df.groupBy(*keys).applyInPandas(function, schema)


def filter_with(df: DataFrame, keys: list[str], predicate: Callable[[pd.DataFrame], bool]) -> DataFrame:
    """The groups for which a function of their rows holds."""
    return df.groupBy(*keys).applyInPandas(lambda pdf: pdf if predicate(pdf) else pdf.iloc[:0], df.schema)

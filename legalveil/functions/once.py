"""Columns that the optimizer neither copies nor moves."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sql import Expr


def once(value: Column | Expr) -> Column:
    """value, computed once for a row where it is defined. Filters above would else be pushed below
    it with a copy of the whole expression for each use, and a single use inside a lambda would be
    computed again for every element. The condition always holds, but the optimizer can't know."""
    return F.when(F.spark_partition_id() >= 0, value.column() if isinstance(value, Expr) else value)


class Steps:
    """Columns added one after another, each computed once, a few in a statement: the plan is
    analysed once for them and not for each. (The analyzer takes several rounds for each layer, and
    has a bound on rounds.)"""

    LAYERS = 6

    def __init__(self, df: DataFrame) -> None:
        self.df, self.columns, self.layers = df, list(df.columns), []

    def add(self, name: str, value: Expr) -> None:
        self.layers.append((name, name in self.columns, value.sql))
        if name not in self.columns:
            self.columns.append(name)
        if len(self.layers) == self.LAYERS:
            self._state("*")

    def _state(self, columns: str) -> None:
        spark, view = self.df.sparkSession, f"legalveil_{uuid.uuid4().hex}"
        text = f"SELECT * FROM {view}"
        for name, known, sql in self.layers:
            text = f"SELECT *{f' EXCEPT (`{name}`)' if known else ''}, CASE WHEN spark_partition_id() >= 0 THEN {sql} END AS `{name}` FROM ({text})"
        self.df.createOrReplaceTempView(view)
        try:
            self.df = spark.sql(f"SELECT {columns} FROM ({text})")
        finally:
            spark.catalog.dropTempView(view)
        self.layers = []

    def select(self, *columns: str) -> DataFrame:
        self._state(", ".join(f"`{c}`" for c in columns))
        return self.df


def step(df: DataFrame, name: str, value: Column | Expr) -> DataFrame:
    return df.withColumn(name, once(value))

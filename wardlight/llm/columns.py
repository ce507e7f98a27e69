"""Columns of a caller under neutral names, so that no name of theirs clashes with one of an operator's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Given:
    """A table with its columns renamed to c0, c1, ... by place; ``back`` puts their names on again."""

    def __init__(self, table: DataFrame):
        self.names = table.columns
        self.inner = [f"c{i}" for i in range(len(self.names))]
        self.table = table.toDF(*self.inner)

    def of(self, name: str) -> str:
        """The neutral name of a column; the first of several."""
        return self.inner[self.names.index(name)]

    def __getitem__(self, name: str) -> Column:
        return F.col(self.of(name))

    def kept(self, *added: str) -> list[str]:
        """Neutral names of all columns but those with these names."""
        return [i for i, n in zip(self.inner, self.names, strict=True) if n not in added]

    def back(self, table: DataFrame, **added: str | Column) -> DataFrame:
        """The columns as they were called, and then the added ones (name: column of table); those replace columns of their name."""
        more = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in added.items()]
        return table.select(*(F.col(i).alias(n) for i, n in zip(self.inner, self.names, strict=True) if n not in added), *more)

"""Table functions for SQL: the strings of a JSON text by LATERAL, and the actor groups of an alert's techniques by partition."""

from __future__ import annotations

from heapq import nsmallest

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


@udtf(returnType="location string, value string")
class JsonStrings:
    """json_strings(text, root): a row for each string in a JSON text, in order, with its path from root."""

    def eval(self, text: str, root: str):
        from ..operators.injection import leaves

        yield from leaves(text, root)


@udtf
class ActorGroups:
    """actor_groups(TABLE(alert_id, code, group), top): the groups that know most of an alert's codes, then by name.

    Declares its own partitioning: the rows of an alert come together, sorted by group, so one group's codes are held at a
    time and ``top`` groups besides. alert_id keeps its type.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, top: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not isinstance(rows.dataType, T.StructType):
            raise ValueError("the first argument is a table: TABLE(alert_id, code, group)")
        names = [f.name for f in rows.dataType.fields]
        if not {"alert_id", "code", "group"} <= set(names):
            raise ValueError(f"columns alert_id, code and group are needed, not {names}")
        if top.value is None or top.value < 1:
            raise ValueError("top is a constant of 1 or more")
        schema = T.StructType([rows.dataType["alert_id"], T.StructField("group", T.StringType()), T.StructField("overlap", T.LongType()), T.StructField("techniques", T.ArrayType(T.StringType())), T.StructField("rank", T.LongType())])
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("alert_id")], orderBy=[OrderingColumn("group")])

    def __init__(self):
        self.alert, self.top, self.group, self.codes, self.best = None, 0, None, set(), []

    def _close(self):
        if self.group is not None and self.codes:
            self.best = nsmallest(self.top, [*self.best, (-len(self.codes), self.group, sorted(self.codes))])

    def eval(self, row, top: int):
        self.alert, self.top = row["alert_id"], top
        if row["group"] != self.group:
            self._close()
            self.group, self.codes = row["group"], set()
        if row["code"] is not None:
            self.codes.add(row["code"])

    def terminate(self):
        self._close()
        for rank, (n, group, codes) in enumerate(self.best, 1):
            yield self.alert, group, -n, codes, rank


def register(spark: SparkSession) -> None:
    """Makes json_strings and actor_groups known to SQL."""
    spark.udtf.register("json_strings", JsonStrings)
    spark.udtf.register("actor_groups", ActorGroups)

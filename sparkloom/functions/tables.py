"""Table functions that take a table and decide on their schema by their arguments."""

from __future__ import annotations

from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn
from pyspark.sql.types import LongType, Row, StructField, StructType, TimestampNTZType


class Funnel:
    """For each user when each of the steps, one after another, was first reached: ``funnel(table(events), 'view,click')``.

    The result has user_id and a column for each step, so its schema follows from the
    second argument; the first one is dealt by user_id and sorted by ts, which the function
    asks for itself.  Of a user only one time for each step is kept while rows pass by.
    """

    def __init__(self):
        self.user, self.steps, self.times = None, None, []

    @staticmethod
    def analyze(rows: AnalyzeArgument, steps: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table")
        names = steps.value.split(",") if steps.isConstantExpression and steps.value else []
        if len(names) < 1 or len(set(names)) < len(names):
            raise ValueError("the steps are different names with commas between them")
        schema = StructType([StructField("user_id", LongType()), *(StructField(f"first_{n}", TimestampNTZType()) for n in names)])
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("user_id")], orderBy=[OrderingColumn("ts"), OrderingColumn("event_id")])

    def eval(self, row: Row, steps: str):
        if self.steps is None:
            self.user, self.steps = row["user_id"], steps.split(",")
        at = len(self.times)
        if at < len(self.steps) and row["event_type"] == self.steps[at] and row["ts"] is not None:
            self.times.append(row["ts"])

    def terminate(self):
        if self.steps is not None:
            yield (self.user, *self.times, *[None] * (len(self.steps) - len(self.times)))

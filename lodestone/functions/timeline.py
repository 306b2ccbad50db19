"""Timelines as a table function in SQL: ``SELECT * FROM timeline(TABLE(items), 20, cursor_time, cursor_source)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SkipRestOfInputTableException

#: The columns that items need; more stay as they are.
NEEDED = ("uri", "ts", "source", "item")


class Timeline:
    """A page of each URI's items: newest first, then by source and item downwards; those that come after the cursor, at most
    ``limit``, with their place. A null cursor begins at the newest. Items without a time come last and are never after a cursor."""

    @staticmethod
    def analyze(items: AnalyzeArgument, limit: AnalyzeArgument, ts: AnalyzeArgument, source: AnalyzeArgument) -> AnalyzeResult:
        schema = items.dataType
        missing = [c for c in NEEDED if not isinstance(schema, StructType) or c not in schema.names]
        if missing:
            raise ValueError(f"timeline needs the columns {', '.join(missing)}")
        down = [OrderingColumn(c, ascending=False, overrideNullsFirst=False) for c in NEEDED[1:]]
        return AnalyzeResult(schema=StructType([*schema.fields]).add("place", LongType()), partitionBy=[PartitioningColumn("uri")], orderBy=down)

    def __init__(self) -> None:
        self.place = 0

    def eval(self, row, limit: int, ts, source: str):
        if limit is not None and self.place >= limit:
            raise SkipRestOfInputTableException("the page is full")
        if ts is not None:
            later = row["ts"] is None or row["ts"] > ts
            if later or row["ts"] == ts and (source is None or row["source"] is None or row["source"] >= source):
                return
        self.place += 1
        yield (*row, self.place)


def register(spark: SparkSession) -> None:
    spark.udtf.register("timeline", udtf(Timeline))

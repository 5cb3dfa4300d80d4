"""A source of our own by the Python Data Source API: seeded test events, in as many partitions as asked."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Slice(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class EventReader(DataSourceReader):
    def __init__(self, rows: int, parts: int, keys: int):
        self.rows, self.parts, self.keys = rows, parts, keys

    def partitions(self):
        cuts = [self.rows * i // self.parts for i in range(self.parts + 1)]
        return [Slice(a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition):
        for i in range(partition.first, partition.last):
            mixed = (i * 2654435761) % 2**32
            yield (i, mixed % self.keys, mixed / 2**32)


class EventSource(DataSource):
    """Options: rows, parts, keys."""

    @classmethod
    def name(cls):
        return "lodeweave_events"

    def schema(self):
        return "id long, key long, value double"

    def reader(self, schema):
        return EventReader(int(self.options.get("rows", 1000)), int(self.options.get("parts", 4)), int(self.options.get("keys", 10)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventSource)

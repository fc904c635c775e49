"""Outside collections that are read a page or some ids at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: (limit, offset) -> the rows of a page, as tuples in the order of the schema.
Page = Callable[[int, int], list[tuple]]


class PageSpan(InputPartition):
    """A task's pages: rows first to last."""

    def __init__(self, first: int, last: int) -> None:
        super().__init__((first, last))
        self.first, self.last = first, last


def page_spans(total: int, size: int, tasks: int | None = None) -> list[PageSpan]:
    """Whole pages dealt to at most `tasks` spans (a page each where it is None), in order."""
    if size <= 0:
        raise ValueError("a page has at least one row")
    pages = -(-total // size)
    step = 1 if tasks is None else max(1, -(-pages // max(1, tasks)))
    return [PageSpan(p * size, min(total, (p + step) * size)) for p in range(0, pages, step)]


def read_paged(spark: SparkSession, count: Callable[[], int], page: Page, schema: str, size: int, tasks: int | None = None, name: str = "paged_collection") -> DataFrame:
    """The rows of a collection that gives its number of rows and pages of them: `count` is called once, on the driver,
    when the plan is made; tasks call `page` with limits of `size`, the last with what is left. A page that returns another
    number of rows than asked for raises, as the collection has changed meanwhile. A task that is tried again asks for
    its pages again."""
    if size <= 0:
        raise ValueError("a page has at least one row")
    total = count()

    class Reader(DataSourceReader):
        def partitions(self) -> list[PageSpan]:
            return page_spans(total, size, tasks) or [PageSpan(0, 0)]

        def read(self, partition: PageSpan) -> Iterator[tuple]:
            for offset in range(partition.first, partition.last, size):
                limit = min(size, partition.last - offset)
                rows = page(limit, offset)
                if len(rows) != limit:
                    raise RuntimeError(f"page of {limit} rows from {offset} on has {len(rows)}")
                yield from rows

    class Collection(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> Reader:
            return Reader()

    spark.dataSource.register(Collection)
    return spark.read.format(name).load()


def looked_up(ids: DataFrame, lookup: Callable[[list], dict], value: str = "string", size: int = 128) -> DataFrame:
    """ids (id) -> id, value: the entries of the named ids alone, each id asked for once, `size` in a call; ids that the
    collection doesn't have are null. `value` is the type in DDL."""
    if size <= 0:
        raise ValueError("a call asks for at least one id")
    kind = ids.schema["id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for lo in range(0, len(pdf), size):
                own = pdf["id"].iloc[lo : lo + size].tolist()
                got = lookup(own)
                yield pd.DataFrame({"id": own, "value": [got.get(i) for i in own]})

    return ids.where("id is not null").select("id").distinct().mapInPandas(run, f"id {kind}, value {value}")

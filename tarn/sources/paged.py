"""A paged service as a Spark data source: each page is a partition, so a lost task fetches its page again.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("fetcher", "package.module:function").option("pages", 10).schema("id long, name string").load()

The fetcher is function(page, options) -> iterable of tuples, importable on the workers.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("give a schema")

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(int(self.options.get("pages", 1)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, function = self.options["fetcher"].partition(":")
        yield from getattr(import_module(module), function)(partition.value, self.options)

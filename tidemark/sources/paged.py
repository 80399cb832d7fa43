"""A paged JSON source as a data source: pages are files or whatever `fetch` returns.

format("paged"): option path is a folder whose files <key>.<page>.json hold {"rows": [...], "next": page or null}; each key
is one input partition, so keys are read side by side and a key's pages one after the other.
"""

import glob
import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Key(InputPartition):
    def __init__(self, key: str):
        self.key = key


class PagedReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names, self.path, self.limit = schema.names, options["path"], int(options.get("limit", 0))

    def partitions(self):
        return [Key(k) for k in sorted({os.path.basename(p).split(".")[0] for p in glob.glob(f"{self.path}/*.json")})]

    def fetch(self, key: str, page: int) -> dict:
        with open(f"{self.path}/{key}.{page}.json") as f:
            return json.load(f)

    def read(self, partition):
        page, n = 0, 0
        while page is not None:
            body = self.fetch(partition.key, page)
            for row in body["rows"]:
                if self.limit and n >= self.limit:
                    return
                n += 1
                yield tuple(partition.key if c == "key" else row.get(c) for c in self.names)
            page = body.get("next")


class PagedSource(DataSource):
    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        return "key string, date string, value double"

    def reader(self, schema):
        return PagedReader(schema, self.options)


def register(spark) -> None:
    spark.dataSource.register(PagedSource)

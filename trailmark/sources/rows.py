"""Row sources of one's own: files of framed records, and any generator of rows, as data sources.

``records_of`` reads through Python's data source interface: a partition for each file, read record by record, so a
file's size does not matter.  ``register`` names a generator of rows so that SQL can call it as a table function.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

NAME = "trailmark_records"


class RecordFiles(DataSource):
    """Payloads of record files: length (8 bytes), its checksum (4), payload, its checksum (4); checksums are not verified."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "payload binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["files"].split("\n"))


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, files: list[str]):
        self.files = [f for f in files if f]

    def partitions(self):
        return [_File(f) for f in self.files] or [_File("")]

    def read(self, partition) -> Iterator[tuple]:
        from pyarrow import fs

        if not partition.value:
            return
        store, name = fs.FileSystem.from_uri(partition.value)
        with store.open_input_stream(name) as stream:
            while head := stream.read(12):
                if len(head) < 12:
                    raise ValueError("a record is cut short")
                (n,) = struct.unpack_from("<Q", head)
                body = stream.read(n + 4)
                if len(body) < n + 4:
                    raise ValueError("a record is cut short")
                yield (body[:n],)


def records_of(spark: SparkSession, path: str) -> DataFrame:
    """``payload`` of every record of the files at a path (a file, a folder or a pattern).

    Files that Arrow's file systems reach are read record by record; others come whole through Spark's reader.
    """
    from pyarrow import fs

    files = [r[0] for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # a row for each file
    uris = [f.replace("file:/", "file:///", 1) if f.startswith("file:/") and not f.startswith("file:///") else f for f in files]
    try:
        for uri in uris[:1]:
            fs.FileSystem.from_uri(uri)
    except Exception:  # a store that only Spark reads
        return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_whole, "payload binary")
    spark.dataSource.register(RecordFiles)
    return spark.read.format(NAME).option("files", "\n".join(uris)).load()


def _whole(batches):
    import pandas as pd

    from .binary import records

    for batch in batches:
        for content in batch["content"]:
            for payload in records(content):
                yield pd.DataFrame({"payload": [payload]})


def register(spark: SparkSession, name: str, rows: Callable[..., Iterator[tuple]], schema: str) -> None:
    """A generator of rows as a table function: ``SELECT * FROM name(arguments)``, laterally joined too."""

    class Rows:
        def eval(self, *args):
            yield from rows(*args)

    spark.udtf.register(name, udtf(Rows, returnType=schema))

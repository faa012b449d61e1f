"""A data source over one folder a key, of which only the folders that are asked for are listed and read."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


@dataclass
class Folder(InputPartition):
    """One file of a folder: a task of its own."""

    key: str
    path: str


class FoldersReader(DataSourceReader):
    """SRC4: files of the folders ``prefix`` and key of ``path`` whose names end in ``file``, as JSON lines; with ``keys``, the other folders are
    neither listed nor read. A line that is no JSON object ends the job, a missing field is null, a blank line is none.

    Keys are an option of the frame. Filters are not pushed: Spark 4.1 keeps what one query pushed with the frame, and a later query of
    the same frame without a filter would get the first one's folders only."""

    def __init__(self, schema: StructType, path: str, file: str, prefix: str, keys: list[str] | None):
        self.names, self.path, self.file, self.prefix, self.keys = schema.fieldNames(), path, file, prefix, keys

    def partitions(self) -> list[Folder]:
        store, root = fs.FileSystem.from_uri(self.path)
        if self.keys is None:
            inside = store.get_file_info(fs.FileSelector(root))
            keys = [i.base_name[len(self.prefix) :] for i in inside if i.type == fs.FileType.Directory and i.base_name.startswith(self.prefix)]
        else:
            keys = [k for k in set(self.keys) if k and "/" not in k and self.prefix + k not in (".", "..")]
        found = []
        for key in sorted(keys):
            files = store.get_file_info(fs.FileSelector(f"{root}/{self.prefix}{key}", allow_not_found=True))
            found += [Folder(key, i.path) for i in files if i.type == fs.FileType.File and i.base_name.endswith(self.file)]
        return found or [Folder("", "")]

    def read(self, partition: Folder) -> Iterator[tuple]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(partition.path) as stream:
            rest = b""
            while block := stream.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                yield from self._rows(partition.key, lines)
            yield from self._rows(partition.key, [rest])

    def _rows(self, key: str, lines: list[bytes]) -> Iterator[tuple]:
        for line in lines:
            if line.strip():
                values = json.loads(line)
                yield tuple(key if n == "key" else values.get(n) for n in self.names)


class Folders(DataSource):
    """``spark.read.format("keyed_folders").schema(...).option("file", ...).load(path)``; the column ``key`` is the folder's name."""

    @classmethod
    def name(cls) -> str:
        return "keyed_folders"

    def reader(self, schema: StructType) -> FoldersReader:
        keys = self.options.get("keys")
        return FoldersReader(schema, self.options["path"], self.options["file"], self.options.get("prefix", ""), None if keys is None else json.loads(keys))


def keyed_folders(spark: SparkSession, path: str, file: str, schema: str, prefix: str = "", keys: list[str] | None = None) -> DataFrame:
    """SRC4, SRC1: rows of the folders of ``keys``, or of all."""
    spark.dataSource.register(Folders)
    reader = spark.read.format("keyed_folders").schema(schema).option("file", file).option("prefix", prefix)
    return (reader if keys is None else reader.option("keys", json.dumps(keys))).load(path)

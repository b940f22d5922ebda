"""Folder listings by tasks: a data source whose partitions are folders.

The driver lists whole levels of folders only until there are enough of them to keep all tasks busy; each partition then walks some of these
folders in a task. File contents are not read. Any store that pyarrow's file systems reach will do (local disks, HDFS, S3, GCS); every task
needs the same access as the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "kinfold-files"
#: Folders that one partition walks, and those at which the driver stops to list levels.
FOLDERS_PER_PARTITION = 4
ENOUGH_FOLDERS = 32
_BATCH = 1 << 14
SCHEMA = "path string, size long"


class Folders(InputPartition):
    def __init__(self, folders: list[str], deep: bool):
        self.folders, self.deep = folders, deep


def _store(root: str):
    """The file system of a folder, its path there, and what stands before such paths to make them addresses."""
    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root, ""
    store, top = fs.FileSystem.from_uri(root)
    return store, top, "" if isinstance(store, fs.LocalFileSystem) else root.rstrip("/").removesuffix(top.rstrip("/"))


def reachable(root: str) -> bool:
    """Whether pyarrow knows the store at all."""
    try:
        _store(root)
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def _children(root: str, folders: list[str], deep: bool) -> Iterator[tuple[bool, str, int]]:
    """(is a folder, path, size) of what the folders hold, or of everything below them."""
    from pyarrow import fs

    store, _, _ = _store(root)
    for folder in folders:
        waiting = [folder]
        while waiting:
            for info in store.get_file_info(fs.FileSelector(waiting.pop())):
                is_folder = info.type == fs.FileType.Directory
                if is_folder and deep:
                    waiting.append(info.path)
                yield is_folder, info.path, info.size or 0


class FilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.per_partition = int(options.get("folders_per_partition", FOLDERS_PER_PARTITION))
        self.enough = int(options.get("enough_folders", ENOUGH_FOLDERS))

    def partitions(self) -> list[Folders]:
        """Levels of folders, from the top, until one has enough; the levels above are read for their own files only."""
        level, parts = [_store(self.root)[1].rstrip("/") or "/"], []
        while level and len(level) < self.enough:
            below = [path for is_folder, path, _ in _children(self.root, level, False) if is_folder]
            parts += self._dealt(level, False)
            level = below
        return parts + self._dealt(level, True)

    def _dealt(self, folders: list[str], deep: bool) -> list[Folders]:
        folders = sorted(folders)
        return [Folders(folders[i : i + self.per_partition], deep) for i in range(0, len(folders), self.per_partition)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        prefix = _store(self.root)[2]
        paths, sizes = [], []
        for is_folder, path, size in _children(self.root, partition.folders, partition.deep):
            if is_folder:
                continue
            paths.append(prefix + path)
            sizes.append(size)
            if len(paths) >= _BATCH:
                yield self._batch(paths, sizes)
                paths, sizes = [], []
        if paths:
            yield self._batch(paths, sizes)

    @staticmethod
    def _batch(paths: list[str], sizes: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sizes, pa.int64())], ["path", "size"])


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)


def list_files(spark: SparkSession, root: str, enough_folders: int = ENOUGH_FOLDERS) -> DataFrame:
    """``path, size`` of every file below a folder, listed by tasks."""
    spark.dataSource.register(Files)
    return spark.read.format(NAME).option("enough_folders", enough_folders).load(root)

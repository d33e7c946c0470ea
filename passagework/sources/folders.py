"""Every file of a folder, as a data source of its own.

Spark's file index leaves out files of zero bytes and names that start with "." or "_". This source lists a folder as it
is, deals the files to partitions by size, and reads each partition in Arrow batches of bounded size on the executors. It
reaches what pyarrow's file systems reach: mounted folders, hdfs, s3, gs.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_PARTITION_BYTES = 64 << 20
_PARTITION_FILES = 2_000
_BATCH_BYTES = 16 << 20
_BATCH_FILES = 1_000


def file_system(folder: str):
    """pyarrow's file system of a folder, the folder inside it, and what goes before its paths."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    if "://" not in folder:
        return fs.LocalFileSystem(), folder.rstrip("/") or "/", ""
    system, path = fs.FileSystem.from_uri(folder)
    scheme = folder.split("://")[0]
    authority = "" if path.split("/")[0] else folder.split("://")[1].split("/")[0]
    return system, path.rstrip("/"), f"{scheme}://{authority}"


class Files(InputPartition):
    def __init__(self, folder: str, paths: list[str]):
        self.folder, self.paths = folder, paths


class FolderSource(DataSource):
    """``spark.read.format("whole_folder").option("folders", json list)``: (path, content) of the files directly inside."""

    @classmethod
    def name(cls) -> str:
        return "whole_folder"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(json.loads(self.options["folders"]))


class FolderReader(DataSourceReader):
    def __init__(self, folders: list[str]):
        self.folders = folders

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        out = []
        for folder in self.folders:
            system, path, _ = file_system(folder)
            held, size = [], 0
            for info in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda i: i.path):
                if info.type != fs.FileType.File:
                    continue
                if held and (size + info.size > _PARTITION_BYTES or len(held) >= _PARTITION_FILES):
                    out.append(Files(folder, held))
                    held, size = [], 0
                held.append(info.path)
                size += info.size
            if held:
                out.append(Files(folder, held))
        return out or [Files("", [])]

    def read(self, partition: Files):
        if not partition.paths:
            return
        system, _, before = file_system(partition.folder)
        paths, contents, size = [], [], 0
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                data = f.read()
            paths.append(before + path)
            contents.append(data)
            size += len(data)
            if size >= _BATCH_BYTES or len(paths) >= _BATCH_FILES:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
                paths, contents, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])


def scan_folder(spark: SparkSession, *folders: str) -> DataFrame:
    """(path, content) of every file directly inside each folder: empty and hidden ones too, subfolders left out.

    The driver lists names and sizes only. Folders that only Spark's readers reach are for ``scan_files``.
    """
    spark.dataSource.register(FolderSource)
    return spark.read.format("whole_folder").option("folders", json.dumps(list(folders))).load()


def write_files(files: DataFrame, folder: str) -> int:
    """Write ``files(name, content)`` as files of those names; returns their number. A task that runs again writes the same."""

    def run(batches):
        system, path, _ = file_system(folder)
        system.create_dir(path)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with system.open_output_stream(f"{path}/{name}") as f:
                    f.write(content.as_buffer() or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    written = files.select("name", F.col("content").cast("binary")).mapInArrow(run, "n bigint")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

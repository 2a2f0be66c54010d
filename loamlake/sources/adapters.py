"""Corpus sources by name: ``spark.read.format("dataset_files").load(folder)``.

A source lists its datasets and their files; what the files hold is read by Spark's own readers, see
:func:`loamlake.sources.files.read_folder`. A further source is one more class here or anywhere else, registered
with the session under its own name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING = "dataset_id string, path string, name string, ext string, bytes bigint"


class DatasetFolder(InputPartition):
    def __init__(self, dataset: str, path: str):
        self.dataset, self.path = dataset, path


class DatasetFiles(DataSource):
    """Folders of a folder are datasets; one partition lists one dataset. Hidden files are left out."""

    @classmethod
    def name(cls) -> str:
        return "dataset_files"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return DatasetFilesReader(self.options["path"], self.options.get("datasets"))


class DatasetFilesReader(DataSourceReader):
    def __init__(self, folder: str, wanted: str | None):
        self.folder, self.wanted = folder, None if wanted is None else set(wanted.split(","))

    def partitions(self) -> list[InputPartition]:
        """Datasets, of which the option ``datasets`` may name a few: their names alone are listed here."""
        system, path = pafs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (pafs.LocalFileSystem(), self.folder)
        found = [i.base_name for i in system.get_file_info(pafs.FileSelector(path)) if i.type == pafs.FileType.Directory and i.base_name[0] not in "._"]
        return [DatasetFolder(name, f"{self.folder.rstrip('/')}/{name}") for name in sorted(found) if self.wanted is None or name in self.wanted]

    def read(self, partition: DatasetFolder) -> Iterator[pa.RecordBatch]:
        system, path = pafs.FileSystem.from_uri(partition.path) if ":/" in partition.path else (pafs.LocalFileSystem(), partition.path)
        rows = []
        for info in system.get_file_info(pafs.FileSelector(path, recursive=True)):
            if info.type == pafs.FileType.File and info.base_name[0] not in "._":
                ext = info.base_name.rsplit(".", 1)[-1].lower() if "." in info.base_name else ""
                rows.append((partition.dataset, info.path, info.base_name, ext, info.size))
        columns = list(zip(*rows)) or [()] * 5
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["dataset_id", "path", "name", "ext", "bytes"])


def register(spark: SparkSession, *sources: type[DataSource]) -> None:
    """Make the sources known to the session by their names."""
    for source in sources or (DatasetFiles,):
        spark.dataSource.register(source)

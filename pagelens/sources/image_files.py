"""Image files as a table of their first bytes: a data source that reads no more of each file than it is asked for.

Many small images are kept in zip archives: a file system takes a block and an entry for each file, and whoever lists a
folder gets all their names, but archives are few and each task lists its own.
"""

from __future__ import annotations

import itertools
import sys
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it, of a URI or a plain path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    paths: list[str]
    sizes: list[int]


class PrefixReader(DataSourceReader):
    """Files are listed once, narrowed by the path filters of the query and dealt into partitions of like numbers.

    With the option ``archives`` the folder's zip archives are the partitions, and their members are the files, under the
    archive's path; each task lists its archive and applies the path filters to it.
    """

    def __init__(self, options: dict):
        self.archives = options.get("archives", "false").lower() == "true"
        self.root, self.prefix, self.per_task = options["path"], int(options.get("prefixbytes", 4096)), int(options.get("filespertask", 2000))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute == ("path",):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        def holds(f: Filter) -> bool:
            if isinstance(f, EqualTo):
                return path == f.value
            if isinstance(f, In):
                return path in f.value
            return path.startswith(f.value) if isinstance(f, StringStartsWith) else path.endswith(f.value)

        return all(map(holds, self.tests))

    def partitions(self) -> list[Files]:
        where, root = opened(self.root)
        found = where.get_file_info(fs.FileSelector(root, recursive=True))
        files = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        if self.archives:
            return [Files([f.path], [f.size]) for f in sorted(files, key=lambda f: f.path) if f.extension == "zip"] or [Files([], [])]
        kept = sorted((f.path, f.size) for f in files if self._wanted(f.path))
        cuts = [kept[i : i + self.per_task] for i in range(0, len(kept), self.per_task)]
        return [Files([p for p, _ in cut], [n for _, n in cut]) for cut in cuts] or [Files([], [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, _ = opened(self.root)
        found = self._members(where, partition) if self.archives else self._files(where, partition)
        while rows := list(itertools.islice(found, 500)):
            paths, sizes, content = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sizes, pa.int64()), pa.array(content, pa.binary())], ["path", "length", "content"])

    def _files(self, where: fs.FileSystem, partition: Files) -> Iterator[tuple[str, int, bytes]]:
        for path, size in zip(partition.paths, partition.sizes):
            with where.open_input_file(path) as file:  # unbuffered: only these bytes are read
                yield path, size, file.read(self.prefix)

    def _members(self, where: fs.FileSystem, partition: Files) -> Iterator[tuple[str, int, bytes]]:
        for archive in partition.paths:
            with where.open_input_file(archive) as file, zipfile.ZipFile(file) as members:
                for member in members.infolist():
                    path = f"{archive}/{member.filename}"
                    if not member.is_dir() and self._wanted(path):
                        with members.open(member) as image:  # unpacked as far as it is read
                            yield path, member.file_size, image.read(self.prefix)


class ImagePrefixes(DataSource):
    """``spark.read.format("image_prefixes").option("prefixBytes", n).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "image_prefixes"

    def schema(self) -> str:
        return "path string, length bigint, content binary"

    def reader(self, schema) -> PrefixReader:
        return PrefixReader(self.options)


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def image_prefixes(spark: SparkSession, folder: str, prefix_bytes: int = 4096, files_per_task: int = 2000, archives: bool = False) -> DataFrame:
    """``path, length, content``: the first bytes of every file below a folder. Filters on ``path`` decide what is opened.

    With ``archives`` the files are those in the folder's zip archives, one task an archive.

    Files are opened by the workers, so the folder must be in a store that they reach: a shared mount, or a URI of an
    object store. An empty folder gives no rows.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImagePrefixes)
    reader = spark.read.format("image_prefixes").option("prefixBytes", prefix_bytes).option("filesPerTask", files_per_task).option("archives", str(archives).lower())
    return reader.load(folder)


def write_image_files(images: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """One file per row; a task that runs again writes the same files again."""
    where, root = opened(folder)
    where.create_dir(root, recursive=True)

    def write(rows: Iterator) -> None:
        where, root = opened(folder)
        for row in rows:
            with where.open_output_stream(f"{root}/{row[0]}") as file:
                file.write(bytes(row[1] or b""))

    images.select(name, content).foreachPartition(write)


class _Sink:
    """Only writes, so that an archive is made as a stream."""

    def __init__(self, file):
        self.write, self.flush = file.write, file.flush


def write_image_archives(images: DataFrame, folder: str, name: str = "name", content: str = "content", per_archive: int = 20_000) -> None:
    """Zip archives of at most ``per_archive`` files, made as the rows come; a task that runs again replaces its own.

    An archive gets its name when it is whole; readers leave out the names of unfinished ones.
    """
    where, root = opened(folder)
    where.create_dir(root, recursive=True)

    def write(rows: Iterator) -> None:
        where, root = opened(folder)
        task = TaskContext.get()
        for n in itertools.count():
            some = itertools.islice(rows, per_archive)
            first = next(some, None)
            if first is None:
                return
            made, whole = f"{root}/_{task.taskAttemptId()}-{n}", f"{root}/{task.partitionId():06d}-{n:06d}.zip"
            with where.open_output_stream(made) as file, zipfile.ZipFile(_Sink(file), "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
                for row in itertools.chain([first], some):
                    archive.writestr(zipfile.ZipInfo(row[0]), bytes(row[1] or b""), zipfile.ZIP_DEFLATED, 1)
            where.move(made, whole)

    images.select(name, content).foreachPartition(write)

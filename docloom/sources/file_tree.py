"""A tree of files: a Python data source that lists it in tasks, and reading and writing its files.

The driver looks at whole folders only until it has found enough of them, and
stops; each of these is listed to its end by a task. So no process lists the
whole tree. The names are then dealt out by hash, and other tasks read the files,
so a folder that holds most files is read by as many tasks as any other.

Names with a leading dot are hidden, names with a leading ``_`` are not. A
missing or empty root gives no rows, an empty file an empty text, and bytes
that are not UTF-8 become replacement characters. Filters of a listing on
``rel_path``, or on its start, choose the folders before anything is listed.
A file that goes between listing and reading fails the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, StringStartsWith

from docloom.session import ship_package

LISTED = "rel_path string, n_bytes long, place string"
READ = "rel_path string, n_bytes long, content string"
# Names that a listing task hands over at once.
NAMES = 10_000
# Text that a task gathers before it hands a batch over; a longer file is a batch of its own.
BATCH_BYTES = 8 * 1024 * 1024


def open_place(place: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" not in place and not place.startswith("file:"):
        place = f"file://{place}"
    system, path = fs.FileSystem.from_uri(quote(place, safe=":/"))
    return system, path.rstrip("/")


@dataclass
class Folder(InputPartition):
    """The files of a folder; with ``deep`` those below it as well."""

    rel: str
    deep: bool


class TreeReader(DataSourceReader):
    def __init__(self, root: str, extension: str, tasks: int):
        self.root, self.extension, self.tasks = root, extension, tasks
        self.prefix = ""

    def pushFilters(self, filters):
        for item in filters:
            # The longest start counts; the filters themselves are still applied afterwards.
            if isinstance(item, (StringStartsWith, EqualTo)) and item.attribute == ("rel_path",):
                if len(item.value) > len(self.prefix):
                    self.prefix = item.value
            yield item

    def _wanted(self, rel: str, folder: bool) -> bool:
        """Whether a path, or for a folder one below it, can begin with the prefix."""
        if folder:
            return f"{rel}/".startswith(self.prefix) or self.prefix.startswith(f"{rel}/")
        return rel.startswith(self.prefix)

    def _children(self, system: fs.FileSystem, top: str, rel: str) -> Iterator[tuple[str, fs.FileInfo]]:
        below = f"{top}/{rel}" if rel else top
        for info in system.get_file_info(fs.FileSelector(below, recursive=False, allow_not_found=True)):
            name = info.base_name
            if not name.startswith("."):
                child = f"{rel}/{name}" if rel else name
                if self._wanted(child, info.type == fs.FileType.Directory):
                    yield child, info

    def partitions(self):
        system, top = open_place(self.root)
        if system.get_file_info(top).type != fs.FileType.Directory:
            return [Folder("", False)]
        # Folders whose own files are read apart, and folders that are not looked into yet.
        opened, waiting = [], [""]
        while waiting and len(waiting) < self.tasks:
            deeper = []
            for at, rel in enumerate(waiting):
                if len(deeper) + len(waiting) - at >= self.tasks and at:
                    deeper += waiting[at:]
                    break
                opened.append(rel)
                deeper += [c for c, info in self._children(system, top, rel) if info.type == fs.FileType.Directory]
            waiting = deeper
        return [Folder(rel, False) for rel in opened] + [Folder(rel, True) for rel in waiting]

    def read(self, partition: Folder):
        system, top = open_place(self.root)
        folders, held = [partition.rel], []
        while folders:
            for child, info in self._children(system, top, folders.pop()):
                if info.type == fs.FileType.Directory:
                    if partition.deep:
                        folders.append(child)
                elif child.endswith(self.extension):
                    held.append((child, info.size, f"{self.root.rstrip('/')}/{child}"))
                    if len(held) == NAMES:
                        yield _batch(held, LISTED)
                        held = []
        if held:
            yield _batch(held, LISTED)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [column.split()[0] for column in schema.split(", ")]
    columns = zip(zip(*rows, strict=True), [pa.string(), pa.int64(), pa.string()], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], names)


class FileTree(DataSource):
    """``spark.read.format("docloom_tree").option("extension", ".html").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "docloom_tree"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], self.options.get("extension", ""), int(self.options.get("tasks", 32)))


def list_file_tree(spark: SparkSession, root: str, extension: str = "", tasks: int | None = None) -> DataFrame:
    """``rel_path, n_bytes, place`` of the files below ``root`` whose names end with ``extension``.

    ``tasks`` is the number of tasks to aim at, by default four for each core.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileTree)
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    return spark.read.format("docloom_tree").option("extension", extension).option("tasks", str(tasks)).load(root)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for rel, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            system, path = open_place(place)
            with system.open_input_stream(path) as file:
                content = file.read()
            held.append((rel, len(content), content.decode("utf-8", "replace")))
            size += len(content)
            if size >= BATCH_BYTES:
                yield _batch(held, READ)
                held, size = [], 0
    if held:
        yield _batch(held, READ)


def read_listed(listing: DataFrame) -> DataFrame:
    """``rel_path, n_bytes, content`` of listed files (rel_path, place), read by tasks of many names each."""
    spark = listing.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return listing.select("rel_path", "place").repartition(tasks, "rel_path").mapInArrow(_contents, READ)


def read_file_tree(spark: SparkSession, root: str, extension: str = "", tasks: int | None = None) -> DataFrame:
    """``rel_path, n_bytes, content`` of the files below ``root`` whose names end with ``extension``."""
    return read_listed(list_file_tree(spark, root, extension, tasks))


def write_file_tree(files: DataFrame, root: str) -> DataFrame:
    """Write ``rel_path, content`` as files below ``root``; gives a row ``rel_path, n_bytes`` for each.

    The result must be read or written for the files to appear. A file appears
    as a whole under its name, and a task that runs twice writes the same file
    again. Of several rows with one path, the one that is written last stays. Null
    contents are empty files; rows without a path are left out. Paths must be safe
    (``paths.stays_inside``); others fail the job.
    """
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, top = open_place(root)
        made = set()
        for batch in batches:
            sizes = []
            for rel, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rel.startswith("/") or ".." in rel.split("/"):
                    raise ValueError(f"path leaves its root: {rel}")
                folder, _, name = f"{top}/{rel}".rpartition("/")
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                data = (content or "").encode("utf-8")
                draft = f"{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as file:
                    file.write(data)
                system.move(draft, f"{folder}/{name}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["rel_path", "n_bytes"])

    rows = files.where("rel_path is not null").select("rel_path", "content")
    return rows.mapInArrow(run, "rel_path string, n_bytes long")

"""Files by Spark's Python data sources: a writer that puts files together from their parts, with commit and
abort, and a reader of archives' members.

    parts.repartition("file").sortWithinPartitions("file", "part").write.format("part_files").mode("append").save(path)
    spark.read.format("archive_members").schema("path string, name string, size long").load(path)
"""

from __future__ import annotations

import sys
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from vocalis.shipping import ship

# Spark pickles sources for workers on the driver too, which don't get what is shipped to executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of archives that a task reads; a larger archive is read by several, each some of its members.
TASK_BYTES = 64 << 20
#: Files that a commit moves at a time.
MOVES = 16


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class PartFilesWriter(DataSourceWriter):
    """Tasks write below a folder of this job; commit moves whole files to their place, abort deletes all.
    A task that runs again writes below another name, and only the one that succeeds is told of."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.job = path, columns, f"_job-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        """Rows (file, ..., content) in order: neighbours of one file are its parts, streamed as they come."""
        system, root = _system(self.path)
        task = f"{self.job}/{uuid.uuid4().hex}"
        system.create_dir(f"{root}/{task}", recursive=True)
        file, content = self.columns.index("file"), self.columns.index("content")
        files: list[str] = []
        now, out = None, None
        try:
            for row in rows:
                if row[file] != now:
                    if out:
                        out.close()
                    now = row[file]
                    if "/" in now or f"{task}/{now}" in files:
                        raise ValueError(f"{now}: parts of a file must stand together, and its name holds no slash")
                    out = system.open_output_stream(f"{root}/{task}/{now}")
                    files.append(f"{task}/{now}")
                out.write(bytes(row[content]))
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _system(self.path)
        names = [f for m in messages if m for f in m.files]
        if len({f.rpartition("/")[2] for f in names}) < len(names):
            self.abort(messages)
            raise ValueError("a file's parts must be in one task")
        with ThreadPoolExecutor(MOVES) as pool:  # moves wait for the file system
            for _ in pool.map(lambda f: system.move(f"{root}/{f}", f"{root}/{f.rpartition('/')[2]}"), names):
                pass
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _system(self.path)
        if system.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.job}")


class PartFiles(DataSource):
    """Writes rows (file string, content binary, any others) as files named by the first."""

    @classmethod
    def name(cls) -> str:
        return "part_files"

    def writer(self, schema: StructType, overwrite: bool) -> PartFilesWriter:
        if overwrite:
            raise ValueError("files are only added")
        return PartFilesWriter(self.options["path"], schema.names)


@dataclass
class Members(InputPartition):
    """Archives (path, bytes), of whose members a task reads every of-th from its own on."""

    paths: list[str]
    own: int
    of: int


class MembersReader(DataSourceReader):
    """Tasks are planned from files' names and sizes alone; archives' directories are read in tasks."""

    def __init__(self, path: str, columns: list[str], task_bytes: int):
        self.path, self.columns, self.task_bytes = path, columns, task_bytes

    def partitions(self) -> list[Members]:
        system, root = _system(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out: list[Members] = []
        together: list[str] = []
        size = 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            if f.size > self.task_bytes:
                of = -(-f.size // self.task_bytes)
                out += [Members([f.path], i, of) for i in range(of)]
                continue
            if together and size + f.size > self.task_bytes:
                out.append(Members(together, 0, 1))
                together, size = [], 0
            together.append(f.path)
            size += f.size
        return out + ([Members(together, 0, 1)] if together else [])

    def read(self, partition: Members) -> Iterator[tuple]:
        system, _ = _system(self.path)
        for path in partition.paths:
            for member in self._members(system, path, partition):
                yield tuple(member.get(c) for c in self.columns)

    def _members(self, system: fs.FileSystem, path: str, partition: Members) -> Iterator[dict]:
        """Names and sizes come from the archive's directory; a member is unpacked only if it is asked for."""
        broken = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError, ValueError)
        unpack = not {"body", "error"}.isdisjoint(self.columns)
        try:
            with system.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
                for i, member in enumerate(archive.infolist()):
                    if i % partition.of != partition.own:
                        continue
                    row = {"path": path, "name": member.filename, "size": member.file_size}
                    try:
                        row["body"] = archive.read(member) if unpack else None
                    except broken as e:
                        row["error"] = f"{type(e).__name__}: {e}"
                    yield row
        except broken as e:
            if partition.own == 0:
                yield {"path": path, "error": f"{type(e).__name__}: {e}"}


class ArchiveMembers(DataSource):
    """Members of the archives below a folder: path, name, size, body, error. Only columns of the schema
    that is asked for are made. An archive that can't be opened is one row without a name."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "path string, name string, size long, body binary, error string"

    def reader(self, schema: StructType) -> MembersReader:
        unknown = set(schema.names) - {"path", "name", "size", "body", "error"}
        if unknown:
            raise ValueError(f"no such columns of an archive: {sorted(unknown)}")
        return MembersReader(self.options["path"], schema.names, int(self.options.get("taskBytes", TASK_BYTES)))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(PartFiles)
    spark.dataSource.register(ArchiveMembers)


def write_parts(parts: DataFrame, path: str) -> None:
    """parts: file, part (its order), content. A file is written by one task, a part at a time."""
    register(parts.sparkSession)
    ordered = parts.select("file", "part", F.col("content")).repartition("file").sortWithinPartitions("file", "part")
    ordered.write.format("part_files").mode("append").save(path)


def archive_members(spark: SparkSession, path: str, columns: str = "path string, name string, size long, body binary, error string", task_bytes: int = TASK_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format("archive_members").schema(columns).option("taskBytes", str(task_bytes)).load(path)

"""Where tables and files are kept: readiness, files by key (read and written), and tables by name."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from factloom.sources.uploads import safe_key

CORE_TABLES = ("collections", "documents", "processing_runs", "source_blocks")


def missing_tables(spark: SparkSession, names: tuple[str, ...] = CORE_TABLES) -> list[str]:
    """The core tables that the catalog does not have."""
    return [n for n in names if not spark.catalog.tableExists(n)]


def writable(spark: SparkSession, root: str) -> bool:
    """Whether the store's root takes a file, wherever Spark's file systems put it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    probe = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.probe")
    try:
        fs = probe.getFileSystem(conf)
        fs.create(probe, True).close()
        return bool(fs.delete(probe, False))
    except Exception:  # any failure means not ready
        return False


def read_objects(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """Files of the store (key, content) for a frame of keys; keys that would leave the root are refused."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":", 1)[-1]
    found = files.selectExpr(f"regexp_replace(path, '^.*{base}/', '') as key", "content")
    return found.join(keys.where(safe_key(keys["key"])).select("key"), "key", "left_semi")


def _at(uri: str):
    """Arrow's file system for a path, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    """How many files a task has put in place."""

    files: int


class ObjectWriter(DataSourceWriter):
    """Files by key: each is written aside and takes its place by a rename, so that no reader meets half a file.

    Keys name contents, so a file that is there already has the same bytes and is replaced by itself when a task is run again.
    When the job ends, well or not, what was left aside is removed; whole files that a failed job has put in place stay.
    """

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")
        self.aside = f"{self.root}/.aside-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = _at(self.root)
        aside = _at(self.aside)[1] + f"/{uuid.uuid4().hex}"
        store.create_dir(aside, recursive=True)
        n = 0
        for row in iterator:
            key, content = row["key"], row["content"]
            if not key or key.startswith("/") or re.search(r"(^|/)\.\.(/|$)", key):
                raise ValueError(f"{key!r} is no key inside the store")
            with store.open_output_stream(f"{aside}/file") as out:
                out.write(bytes(content or b""))
            store.create_dir(f"{root}/{key}".rpartition("/")[0], recursive=True)
            store.move(f"{aside}/file", f"{root}/{key}")
            n += 1
        return Written(n)

    def _clear(self) -> None:
        from pyarrow import fs

        store, aside = _at(self.aside)
        if store.get_file_info(aside).type != fs.FileType.NotFound:
            store.delete_dir(aside)

    def commit(self, messages: list[Written | None]) -> None:
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


class ObjectStore(DataSource):
    """df (key, content) .write.format("objects").option("path", root).mode("append").save()"""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return "key string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> ObjectWriter:
        if overwrite:
            raise ValueError("files of the store are never overwritten as a whole")
        return ObjectWriter(self.options["path"])


def write_objects(files: DataFrame, root: str) -> None:
    """Puts files (key, content) into the store."""
    files.sparkSession.dataSource.register(ObjectStore)
    files.select("key", "content").write.format("objects").option("path", root).mode("append").save()

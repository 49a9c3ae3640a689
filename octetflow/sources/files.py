"""Folders of files as tables, and tables as files."""

from __future__ import annotations

import contextlib
import os
import re
import uuid

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from octetflow.functions.names import relative
from octetflow.operators import archive, shares


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, r"^(\w+):/+", "$1:/")


def _empty(found: DataFrame) -> DataFrame:
    """Paths of the files that the scan lists but does not return, as it leaves out empty ones. The names stay in the JVM, which holds them for the scan anyway."""
    spark = found.sparkSession
    scala = spark._jvm.scala
    listed = scala.jdk.javaapi.CollectionConverters.asJava(scala.collection.immutable.ArraySeq.unsafeWrapArray(found._jdf.inputFiles()))
    rows = DataFrame(spark._jsparkSession.createDataset(listed, spark._jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    paths = rows.select(F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B"))).alias("path"))
    return paths.join(found.select("path"), _plain(paths["path"]) == _plain(found["path"]), "left_anti")


def scan(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, relative_path, size, modified, content) of the regular files; of empty ones, modified is null. Filter on path, size and modified before touching the content: these reach the scan."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    full = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    none = _empty(found).select("path", F.lit(0).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified"), F.lit(b"").alias("content"))
    rows = full.unionByName(none)
    return rows.select("path", relative(_plain(F.col("path")), _plain(F.lit(root))).alias("relative_path"), "size", "modified", "content")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return archive.unpack(spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("archive")))


def read_zips(spark: SparkSession, path: str) -> DataFrame:
    return archive.zip_unpack(spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("archive")))


def read_shares(spark: SparkSession, path: str) -> DataFrame:
    """(path, fields of a share) of stored shares."""
    import pyarrow as pa

    run = F.arrow_udf(lambda x: pa.array([shares.read_share(v) for v in x.to_pylist()], shares._KIND), shares.SCHEMA)
    return spark.read.format("binaryFile").load(path).select("path", run("content").alias("s")).select("path", "s.*")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, fields): flat JSON maps of strings."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return text.select("path", F.from_json("value", "map<string,string>").alias("fields"))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file, by a temporary name, on any store that Spark knows."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    to, part = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(data))
    out.close()
    fs.delete(to, False)
    if not fs.rename(part, to):
        raise OSError(f"could not write {path}")


class _Range(InputPartition):
    """Stretches of files: (path, size, first block, blocks)."""

    def __init__(self, parts: list[tuple[str, int, int, int]]):
        self.parts = parts


class _BlockReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size, self.task = options["path"], int(options.get("blocksize", 1 << 20)), int(options.get("taskbytes", 128 << 20))
        if self.size < 1 or self.size > 1 << 30:
            raise ValueError("blocks have 1 byte to 1 GiB")

    def partitions(self):
        """Files are cut into stretches of about ``taskbytes``; small ones share a task. Only names and sizes are read here."""
        fs, root = FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.type == FileType.File else sorted((f for f in fs.get_file_info(FileSelector(root, recursive=True)) if f.type == FileType.File), key=lambda f: f.path)
        out, parts, room = [], [], self.task
        for f in found:
            count = max(1, -(-f.size // self.size))
            at = 0
            while at < count:
                n = min(count - at, max(1, room // self.size))
                parts.append((f.path, f.size, at, n))
                at, room = at + n, room - n * self.size
                if room < self.size:
                    out.append(_Range(parts))
                    parts, room = [], self.task
        return [*out, _Range(parts)] if parts else out

    def read(self, partition):
        fs, _ = FileSystem.from_uri(self.path)
        for path, size, first, n in partition.parts:
            with fs.open_input_file(path) as f:
                for k in range(first, first + n):
                    data = f.read_at(min(self.size, size - k * self.size), k * self.size) if size else b""
                    if len(data) != max(0, min(self.size, size - k * self.size)):
                        raise OSError(f"{path} has become shorter")
                    yield path, size, k, data


class BlockSource(DataSource):
    """``spark.read.format("octet_blocks").load(uri)``: files of any size as rows (path, size, block_no, bytes), which tasks read by ranges. Options: ``blockSize`` (bytes, 1 MiB) and ``taskBytes``
    (128 MiB). An empty file has one empty block. The URI is of any store that Arrow opens and that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "octet_blocks"

    def schema(self) -> str:
        return "path string, size long, block_no long, bytes binary"

    def reader(self, schema) -> DataSourceReader:
        return _BlockReader(self.options)


def _shared_path(path: str) -> str:
    """A path of the file system that driver and executors share. The sinks write by places, which other stores don't offer, so they are refused instead of ending up in a local folder of that name."""
    scheme = path.split(":", 1)[0] if re.match(r"\w[\w+.-]+:/", path) else "file"
    if scheme != "file":
        raise ValueError(f"the sinks write to folders that driver and executors share, not to {scheme}: stores")
    return re.sub(r"^file:/+", "/", path)


class _Done(WriterCommitMessage):
    def __init__(self, names: list[tuple[str, str]]):
        self.names = names


class _FileWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def write(self, iterator) -> WriterCommitMessage:
        names = []
        try:
            for row in iterator:
                to = os.path.join(self.folder, archive.safe_path(row["relative_path"]))
                os.makedirs(os.path.dirname(to), exist_ok=True)
                part = f"{to}.{self.job}.{uuid.uuid4().hex}.part"
                names.append((part, to))
                with open(part, "wb") as f:
                    f.write(row["content"])
        except BaseException:
            for part, _ in names:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(part)
            raise
        return _Done(names)

    def _sweep(self) -> None:
        """Removes what attempts that were lost with their executor have left."""
        for at, _, names in os.walk(self.folder):
            for name in names:
                if name.endswith(".part") and f".{self.job}." in name:
                    os.remove(os.path.join(at, name))

    def commit(self, messages) -> None:
        for m in messages:
            for part, to in m.names if m else []:
                os.replace(part, to)
        self._sweep()

    def abort(self, messages) -> None:
        self._sweep()


class FileSink(DataSource):
    """``df.write.format("octet_files").mode("append").save(folder)``: rows (relative_path, content) as files of a folder that driver and
    executors share; names become final only when all tasks are done."""

    @classmethod
    def name(cls) -> str:
        return "octet_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(_shared_path(self.options["path"]))


class _ArchiveWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.part = path, f"{path}.{uuid.uuid4().hex}.part"
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)

    def write(self, iterator) -> WriterCommitMessage:
        out = os.open(self.part, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            for row in iterator:
                data, at = memoryview(row["piece"]), row["offset"]
                while data:
                    done = os.pwrite(out, data, at)
                    data, at = data[done:], at + done
        finally:
            os.close(out)
        return _Done([])

    def commit(self, messages) -> None:
        os.replace(self.part, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class ArchiveSink(DataSource):
    """``pieces(files).write.format("octet_archive").mode("append").save(file)``: every task writes its pieces (offset, piece) at their places of one file, in a
    folder that driver and executors share. A repeated task writes the same bytes again."""

    @classmethod
    def name(cls) -> str:
        return "octet_archive"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ArchiveWriter(_shared_path(self.options["path"]))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileSink)
    spark.dataSource.register(ArchiveSink)
    spark.dataSource.register(BlockSource)

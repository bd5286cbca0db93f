"""Folders of files: scans by name and size, heads of growing files, the newest readable snapshot."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .listings import image_camera, image_time

#: Bytes of a file's head that are read, files that one task reads, and lines sent on at once.
HEAD_BYTES = 65_536
FILES_PER_TASK = 64
LINES = 4096


def scan(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """``path, top, name, size_bytes, modified_utc`` of all files below a folder, without reading them.

    ``top`` is the first folder below it. Hidden files and folders (``_``, ``.``) are left out.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = (reader.option("pathGlobFilter", f"*{suffix}") if suffix else reader).load(folder)
    below = F.split_part(F.col("path"), F.lit(f"{folder.split(':', 1)[-1].rstrip('/')}/"), F.lit(-1))
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("path", F.split_part(below, F.lit("/"), F.lit(1)).alias("top"), name.alias("name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_utc"))


def scan_images(spark: SparkSession, folder: str, suffix: str = ".jpg") -> DataFrame:
    """``station_id, camera, time_utc, size_bytes, path`` of files named as images; others are left out."""
    files = scan(spark, folder, suffix)
    return files.select(F.col("top").alias("station_id"), image_camera("name").alias("camera"), image_time("name").alias("time_utc"), "size_bytes", "path").where("time_utc is not null")


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a mounted folder, or of any address that Arrow opens."""
    return pafs.FileSystem.from_uri(folder) if ":/" in folder else (pafs.LocalFileSystem(), folder)


class HeadReader(DataSourceReader):
    """Tasks of some files each. A file is opened and only its first bytes are read."""

    def __init__(self, options: dict):
        self.folder, self.size = options["path"], int(options.get("bytes", HEAD_BYTES))
        self.suffix, self.per_task = options.get("suffix", ""), int(options.get("filespertask", FILES_PER_TASK))

    def partitions(self) -> list[InputPartition]:
        fs, path = store(self.folder)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        visible = lambda p: not any(x.startswith(("_", ".")) for x in p.removeprefix(path).split("/"))
        paths = sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(self.suffix) and visible(f.path))
        return [InputPartition(tuple(paths[k : k + self.per_task])) for k in range(0, len(paths), self.per_task)] or [InputPartition(())]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = store(self.folder)
        for path in partition.value:
            with fs.open_input_file(path) as f:
                size, head = f.size(), f.read(self.size)
            whole = head[: head.rfind(b"\n") + 1]  # what follows the last line end may still grow
            lines = whole.decode("utf-8", errors="replace").split("\n")[:-1]
            for start in range(0, len(lines), LINES):
                part = [x.removesuffix("\r") for x in lines[start : start + LINES]]
                n = len(part)
                numbers = pa.array(range(start + 1, start + 1 + n), pa.int64())
                yield pa.record_batch({"path": pa.array([path] * n), "size_bytes": pa.array([size] * n, pa.int64()), "line_no": numbers, "line": pa.array(part)})


class FileHeads(DataSource):
    """``spark.read.format("file_heads")``. Options: ``path``, ``bytes``, ``suffix``, ``filesPerTask``."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, size_bytes long, line_no long, line string"

    def reader(self, schema) -> HeadReader:
        return HeadReader(dict(self.options))


def heads(spark: SparkSession, folder: str, size: int = HEAD_BYTES, suffix: str = "", per_task: int = FILES_PER_TASK) -> DataFrame:
    """The complete lines within the first ``size`` bytes of each file: ``path, size_bytes, line_no, line``.

    A last line without an end is cut or still being written and is left out, even at the end of the file.
    Bytes that aren't UTF-8 become replacement characters. A file without a complete line gives no row.
    """
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").options(path=folder, bytes=size, suffix=suffix, filesPerTask=per_task).load()


class LineWriter(DataSourceArrowWriter):
    """A file for each run of rows with one ``top``, in a folder of that name.

    It appears under its name when it is whole, and a task that is repeated puts it there again.
    """

    def __init__(self, options: dict):
        self.folder = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        (fs, path), task, attempt = store(self.folder), TaskContext.get().partitionId(), uuid.uuid4().hex
        out, current = None, None

        def close() -> None:
            out.close()
            fs.move(f"{path}/{current}/_{attempt}", f"{path}/{current}/part-{task:05d}.txt")

        for batch in batches:
            tops = batch.column("top").to_pylist()
            lines = batch.column("line").to_pylist()
            start = 0
            for k in range(1, len(tops) + 1):
                if k < len(tops) and tops[k] == tops[start]:
                    continue
                if tops[start] != current:
                    if out:
                        close()
                    current = tops[start]
                    fs.create_dir(f"{path}/{current}", recursive=True)
                    out = fs.open_output_stream(f"{path}/{current}/_{attempt}")
                out.write("".join(f"{x}\n" for x in lines[start:k]).encode())
                start = k
        if out:
            close()
        return WriterCommitMessage()


class LineFiles(DataSource):
    """``df.write.format("line_files")`` of rows ``top, line``. Option: ``path``."""

    @classmethod
    def name(cls) -> str:
        return "line_files"

    def schema(self) -> str:
        return "top string, line string"

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(dict(self.options))


def write_lines(df: DataFrame, folder: str, *, top: str, line: str) -> None:
    """One text file for each ``top``, in the folder ``top=<value>``; a row is a line, in the order of the rows.

    The rows of a ``top`` are next to each other in one task. Opening many small files takes Spark's own writer some
    calls of the shell each, which grow into most of the time.
    """
    spark = df.sparkSession
    spark.dataSource.register(LineFiles)
    fs, path = store(folder)
    fs.create_dir(path, recursive=True)  # there even without rows
    rows = df.select(F.concat(F.lit("top="), F.coalesce(top, F.lit("__HIVE_DEFAULT_PARTITION__"))).alias("top"), F.coalesce(line, F.lit("")).alias("line"))
    rows.write.format("line_files").option("path", folder).mode("append").save()


def bytes_needed(last: Column, now: Column, per_hour: int, most: int = HEAD_BYTES, margin_h: float = 2.0) -> Column:
    """How much of a file's head holds the rows since ``last``; everything if nothing is known."""
    hours = F.greatest((F.unix_micros(now) - F.unix_micros(last)) / 3.6e9, F.lit(0.0)) + margin_h
    return F.when(last.isNull(), F.lit(most)).otherwise(F.least(F.ceil(hours * per_hour), F.lit(most))).cast("long")


def newest_readable(spark: SparkSession, folder: str, stamp: Callable[[Column], Column], readable: Callable[[Column], Column], step: int = 8) -> DataFrame:
    """``path, stamp, text`` of the newest file that can be read; no row if there is none.

    ``stamp`` of a path is NULL for files that aren't snapshots. Snapshots are tried from the newest on, a few
    at a time and each time eight times as many, so a year of them isn't read because the last one is cut.
    """
    files = scan(spark, folder).select("path", stamp(F.col("path")).alias("stamp")).where("stamp is not null")
    before = F.lit(True)
    while True:
        some = files.where(before).orderBy(F.desc("stamp"), F.desc("path")).limit(step).collect()
        if not some:
            return files.limit(0).withColumn("text", F.lit(None).cast("string"))
        texts = spark.read.text([r["path"] for r in some], wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        good = texts.where(F.coalesce(readable(F.col("text")), F.lit(False))).select("path", stamp(F.col("path")).alias("stamp"), "text")
        newest = good.orderBy(F.desc("stamp"), F.desc("path")).limit(1)
        if newest.take(1):
            return newest
        oldest = some[-1]
        before = (F.col("stamp") < F.lit(oldest["stamp"])) | ((F.col("stamp") == F.lit(oldest["stamp"])) & (F.col("path") < oldest["path"]))
        step *= 8

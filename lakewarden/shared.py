"""The folder that driver and executors share, and tables kept in it."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without one gets a temporary folder of its own."""
    given = spark.conf.get("spark.checkpoint.dir", "") or ""
    if given:
        return given.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lakewarden-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def new_folder(spark: SparkSession, name: str) -> Path:
    """The same for files that are written without Spark: a folder of a file system that is mounted everywhere."""
    path = new_path(spark, name)
    if not re.match(r"(file:)?/", path):
        raise ValueError(f"{path} is not a mounted folder")
    folder = Path("/" + path.removeprefix("file:").lstrip("/"))
    folder.mkdir(parents=True)
    return folder


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again: values are fixed, lineage is cut."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_file(df: DataFrame, path: str | Path, encode: Callable[[pa.RecordBatch], bytes], head: bytes = b"", tail: bytes = b"", skip: int = 0) -> None:
    """The rows of ``df`` in their order as one file: ``encode`` makes bytes of them in the tasks, ``skip`` bytes are left out before the first row.

    Tasks write parts to the shared folder and tell their sizes, a row each; with these, tasks copy the parts to
    their places. Only a file outside the shared folder, which tasks may not see, is put together by the driver, a
    block at a time.
    """
    spark, path = df.sparkSession, Path(path)
    folder = str(new_folder(spark, "parts"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, size = f"{folder}/{uuid.uuid4().hex}", 0
        with open(part, "wb") as f:
            for batch in batches:
                size += f.write(encode(batch))
        yield pa.RecordBatch.from_pydict({"i": [TaskContext.get().partitionId()], "part": [part], "size": [size]})

    parts, places, end = sorted((r["i"], r["part"], r["size"]) for r in df.mapInArrow(write, "i bigint, part string, size bigint").collect()), [], len(head)  # a row per part
    for _, part, size in parts:
        if size:
            left = skip if not places else 0
            places.append((part, left, end))
            end += size - left
    with path.open("wb") as f:
        f.write(head)
        f.seek(end)
        f.write(tail)
        f.truncate()

    def copy(i: int) -> None:
        part, left, at = places[i]
        with open(part, "rb") as source, open(path, "r+b") as target:
            source.seek(left)
            target.seek(at)
            shutil.copyfileobj(source, target, 1 << 20)

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                copy(i)
            yield batch

    if path.resolve().is_relative_to(Path(folder).resolve().parent):
        spark.range(0, len(places), 1, max(len(places), 1)).mapInArrow(copied, "id bigint").count()
    else:
        for i in range(len(places)):
            copy(i)
    shutil.rmtree(folder, ignore_errors=True)

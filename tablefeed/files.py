"""Small file operations on whatever file system a path is on, through Hadoop's client."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _open(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _open(spark, path)
    fs.delete(where, True)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Make a folder that goes when the driver's JVM ends."""
    fs, where = _open(spark, path)
    if not fs.exists(where):
        fs.mkdirs(where)
        fs.deleteOnExit(where)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    fs, where = _open(spark, path)
    return fs.getContentSummary(where).getLength()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file that is there with all its text or not at all."""
    fs, where = _open(spark, path)
    if fs.exists(where):
        raise OSError(f"{path} is there already")
    _, draft = _open(spark, f"{path}.draft-{uuid.uuid4().hex}")
    write_text(spark, draft.toString(), text)
    if not fs.rename(draft, where):
        fs.delete(draft, False)
        raise OSError(f"could not write {path}")


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, where = _open(spark, folder)
    if not fs.exists(where):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(where))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _open(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _open(spark, path)
    source = fs.open(where)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()

"""The few file-system calls that DataFrames don't cover, through the Hadoop
client of the session, so that any shared storage works."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    at, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _at(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that must not exist, whole or not at all: under another
    name first, then renamed in place. False if the name is taken."""
    at, fs = _at(spark, path)
    temp, _ = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(temp, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(temp, at, options)
        return True
    except Exception as e:
        fs.delete(temp, False)
        if "FileAlreadyExistsException" in str(e):
            return False
        raise

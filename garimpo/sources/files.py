"""What the file system tells while planning: heads of files, small files, names.

Goes through Hadoop's file systems, as Spark does, so any path that Spark reads will do. No
job is run.
"""

from __future__ import annotations

import re

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str) -> JavaObject:
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str) -> JavaObject:
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def qualified(spark: SparkSession, path: str) -> str:
    """A path as the metadata columns of a scan spell it."""
    whole = _system(spark, path).makeQualified(_path(spark, path))
    uri = spark._jvm.org.apache.spark.paths.SparkPath.fromPath(whole).urlEncoded()
    return re.sub("^file:/+", "file:/", uri)


def is_folder(spark: SparkSession, path: str) -> bool:
    return exists(spark, path) and _system(spark, path).getFileStatus(
        _path(spark, path)
    ).isDirectory()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies directly in a folder, in order; none if there is no folder."""
    if not exists(spark, folder):
        return []
    found = _system(spark, folder).listStatus(_path(spark, folder))
    return sorted(entry.getPath().getName() for entry in found)


def head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file, ``size`` at most."""
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(
            spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)
        ))
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that appears whole; False if there is one of that name."""
    jvm = spark._jvm
    target = _path(spark, path)
    draft = _path(spark, f"{path}.{jvm.java.util.UUID.randomUUID().toString()}")
    system = _system(spark, path)
    stream = system.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        draft.toUri(), spark._jsc.hadoopConfiguration()
    )
    never = spark.sparkContext._gateway.new_array(
        getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0
    )
    try:
        context.rename(system.makeQualified(draft), system.makeQualified(target), never)
    except Exception:
        system.delete(draft, False)
        if system.exists(target):
            return False
        raise
    return True


def delete_folder(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_path(spark, path), True)

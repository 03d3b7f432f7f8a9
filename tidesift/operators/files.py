"""Small files beside the tables, on any file system Spark can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    place, system = _place(spark, path)
    system.delete(place, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole text of a small file, None if there is none."""
    place, system = _place(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a text in the place of a file's old one: readers see the one or the other, never a part."""
    place, system = _place(spark, path)
    other, _ = _place(spark, f"{path}.{uuid.uuid4().hex}")
    stream = system.create(other, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    jvm = spark._jvm
    overwrite = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(system.makeQualified(other), system.makeQualified(place), overwrite)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of the last change) of a file, or of all files of a folder, sorted; a missing path raises."""
    place, system = _place(spark, path)
    system.getFileStatus(place)
    found, files = [], system.listFiles(place, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is not there."""
    place, system = _place(spark, path)
    if not system.exists(place):
        return []
    return sorted(f.getPath().getName() for f in system.listStatus(place) if f.isDirectory())


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table's writer has come to its end."""
    place, system = _place(spark, f"{path}/_SUCCESS")
    return system.exists(place)

"""Small files and folders on any file system that Spark can write."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def qualified(spark: SparkSession, path: str) -> str:
    """The absolute form of a path, with its scheme."""
    fs, place = _at(spark, path)
    return fs.makeQualified(place).toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no folder."""
    fs, place = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """Move a file or folder to a name that is free; false if it is taken."""
    fs, place = _at(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(target.getParent())
    return not fs.exists(target) and fs.rename(place, target)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file aside and give it its name; what had the name before is replaced."""
    aside = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
    fs, place = _at(spark, aside)
    out = fs.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.rename(place, target):
        fs.delete(target, False)
        fs.rename(place, target)


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _at(spark, path)
    stream = fs.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()

"""Small files and folders on any store that Spark reads, through its own file systems (driver side)."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """Write a small file that is seen whole or not at all: under another name first, then renamed.

    Without ``replace`` a file of that name is an error.
    """
    fs, p = _at(spark, path)
    draft = _at(spark, f"{path}.{uuid.uuid4().hex[:8]}.draft")[1]
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(p):
        if not replace:
            fs.delete(draft, False)
            raise FileExistsError(path)
        fs.delete(p, False)
    if not fs.rename(draft, p):
        raise OSError(f"could not publish {path}")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)

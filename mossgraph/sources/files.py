"""Small files in any store that Spark reaches: manifests and claims, through the session's own file systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def create_once(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False if it is there already.  Of several writers one alone gets True."""
    fs, target = _at(spark, path)
    fs.mkdirs(target.getParent())
    try:
        return bool(fs.createNewFile(target))
    except Exception as error:  # some stores raise instead of saying no
        if "already exists" in str(error) or "FileAlreadyExists" in str(error):
            return False
        raise


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _at(spark, path)
    fs.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file whole: under another name first, then renamed."""
    fs, target = _at(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    if not exists(spark, path):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, sha256)`` of every file under ``path`` that has content, each hashed by a task; Spark reads no empty files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", F.sha2("content", 256).alias("sha256"))

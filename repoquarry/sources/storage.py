"""Paths of the file system Spark writes to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _file_system(spark, path)
    return fs.exists(hadoop)


def create_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a new small file; it is an error if it is there."""
    fs, hadoop = _file_system(spark, path)
    out = fs.create(hadoop, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_file(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    return spark.read.text(path, wholetext=True).first().value


def entries(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names in a folder with their times of change, in milliseconds; none if there is no
    such folder."""
    fs, hadoop = _file_system(spark, path)
    if not fs.exists(hadoop):
        return []
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(hadoop)]


def delete_path(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _file_system(spark, path)
    return fs.delete(hadoop, True)

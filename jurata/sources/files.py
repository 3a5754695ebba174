"""Small files of the driver (reports, manifests, workbooks) through the cluster's own file systems.

Any path that Spark's writers take is taken here, so a file lies beside the tables written under the same folder. Whole
files pass through the driver: they are bounded by contract (reports of a fixed size, workbooks of one run).
"""

from __future__ import annotations

import hashlib
from typing import BinaryIO

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _system(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _system(spark, path)
    fs.delete(at, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Renames a file or folder to a place where nothing is yet."""
    fs, at = _system(spark, path)
    goal = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(goal.getParent())
    if not fs.rename(at, goal):
        raise OSError(f"could not rename to {to}")


def _replace(spark: SparkSession, part: str, path: str) -> None:
    """Renames a written file over an older one in one step, where the file system can; there is always one of both."""
    jvm = spark.sparkContext._jvm
    fs, at = _system(spark, part)
    goal = jvm.org.apache.hadoop.fs.Path(path)
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    except Py4JJavaError:  # a store without such renames: its objects appear whole anyway
        fs.delete(goal, False)
        if not fs.rename(at, goal):
            raise OSError(f"could not rename to {path}") from None
        return
    context.rename(at, goal, how)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a file wholly or not at all: to a hidden part file that takes an older one's place at the end."""
    folder, _, name = path.rpartition("/")
    part = f"{folder}/.{name}.part"
    fs, at = _system(spark, part)
    out = fs.create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    _replace(spark, part, path)


class TooLarge(ValueError):
    """An upload above its limit."""


def put_stream(spark: SparkSession, path: str, stream: BinaryIO, limit: int, piece: int = 1 << 20) -> tuple[int, str]:
    """(bytes, sha256) of a stream copied to path piece by piece; above the limit, or if the stream fails, nothing is left of it and an older file stays."""
    folder, _, name = path.rpartition("/")
    part = f"{folder}/.{name}.part"
    fs, at = _system(spark, part)
    size, digest, whole = 0, hashlib.sha256(), False
    out = fs.create(at, True)
    try:
        while data := stream.read(piece):
            size += len(data)
            if size > limit:
                raise TooLarge(f"more than {limit} bytes")
            digest.update(data)
            out.write(bytearray(data))
        whole = True
    finally:
        out.close()
        if not whole:
            fs.delete(at, False)
    _replace(spark, part, path)
    return size, digest.hexdigest()


def contents(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, content) of whole files; file is a plain path for local ones."""
    return spark.read.format("binaryFile").load(list(paths)).select(F.regexp_replace("path", "^file:/*", "/").alias("file"), "content")


def get(spark: SparkSession, path: str) -> bytes:
    return bytes(contents(spark, path).first()["content"])

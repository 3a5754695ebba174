"""Where intermediate tables of the operators go, and the Arrow batch bound they rely on.

Tables that an operator writes are read by the DataFrame it returns, so they are left in the shared folder. Who writes
that DataFrame at once (settled() does) can have them deleted. What was written is known to the call that asked for it
alone (a context variable), so operators may run in several threads of a driver.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest Arrow batch handed to Python, so that very long texts never meet in one batch.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes in this session, for good: results are lazy (rows alone don't bound memory)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a fresh local one, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="jurata-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def unused(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parted(rows: DataFrame, keys: list[str], per: int) -> DataFrame:
    """rows with a column `part`: the rows of a key are dealt by hash to parts of about `per` rows, so that a group of (keys, part) stays small."""
    sizes = written(rows.groupBy(*keys).agg(F.ceil(F.count("*") / per).cast("long").alias("parts")), "parts")
    rest = [c for c in rows.columns if c not in keys]
    return rows.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64(*rest), F.col("parts"))).drop("parts")


#: Paths of the tables that the innermost scratch() of this call has seen written, oldest first.
_paths: ContextVar[list[str] | None] = ContextVar("paths", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/jurata/{name}-{uuid.uuid4().hex}"


#: Has Spark delete the shuffle files of a query once that has ended.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Writes df as a table of its own in the shared folder and reads it back: cuts lineage, survives lost executors.

    tidy has the shuffle files of the writing deleted after it, as nothing else reads them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if (mine := _paths.get()) is not None:
        mine.append(path)
    was = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true" if tidy else was)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_TIDY, was)
    return spark.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with `place`, from 0 in the given order, and `part`, the sorted partition they are in: a range sort, written, and one count per partition."""
    rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("part", F.shiftright("_at", 33))
    before, offsets = 0, []
    for part, n in sorted(map(tuple, rows.groupBy("part").count().collect())):  # one row per sorted partition
        offsets.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(offsets, "part long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(offsets), "part").withColumn("place", place).drop("_at", "_before")


def deleted(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the tables that are written inside, in this thread, at its end; who keeps one takes its path off the list."""
    mine: list[str] = []
    token = _paths.set(mine)
    try:
        yield mine
    finally:
        _paths.reset(token)
        deleted(spark, mine)


def settled(make: Callable[[], DataFrame], name: str, spent: list[str] | None = None) -> DataFrame:
    """The written result of make(); the tables written on the way to it are deleted, and those whose paths are in `spent`, which has the result's path then."""
    with scratch(SparkSession.active()) as mine:
        out = written(make(), name)
        path = mine.pop()
    if spent is not None:
        deleted(out.sparkSession, spent)
        spent[:] = [path]
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

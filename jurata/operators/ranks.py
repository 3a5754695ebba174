"""Places of all rows in one order, without bringing them to one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a fresh local one, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="jurata-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def ranked(rows: DataFrame, order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """rows with their place from 1 in a total order: a range sort, positions inside each partition and one count per partition.

    The sorted rows are written to the shared folder, so that places stay the same if a task is run again.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/jurata/sorted-{uuid.uuid4().hex}"
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    counts = sorted(placed.groupBy("_part").count().collect())  # one row per sorted partition
    before, offsets = 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    offsets = spark.createDataFrame(offsets, "_part long, _before long")
    place = (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias(name)
    return placed.join(F.broadcast(offsets), "_part").select(*rows.columns, place)


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows, written to the shared folder and read back, so that the planner knows their size."""
    path = f"{shared_folder(rows.sparkSession)}/jurata/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """rows with their place from 1 among the rows of the same keys: a range sort of all rows, and the rows of a key counted per sorted partition.

    A key's rows may lie in many partitions, so one key with most of the rows isn't one task's work.
    """
    placed = kept(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    spans = placed.groupBy(part.alias("_part"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = W.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    spans = kept(spans.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"), "spans")
    same = part == F.col("_part")
    for i, k in enumerate(keys):
        same &= placed[k].eqNullSafe(F.col(f"_k{i}"))
    return placed.join(spans, same).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name))

"""The workbook source with its filters, and the sink under repeated and failing tasks."""

import os
import zipfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jurata.sources import files, xlsx


@pytest.fixture
def reader(spark):
    spark.dataSource.register(xlsx.XlsxDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda path: spark.read.format("xlsx").option("pushdown", "true").load(path)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def names(folder):
    return sorted(f for f in os.listdir(folder) if not f.endswith(".crc"))


def test_two_attempts(tmp_path, monkeypatch):
    """Two attempts of one partition write side by side; the one that is committed counts, the other leaves nothing."""
    import pyspark

    writer = xlsx.XlsxWriter(T.StructType([T.StructField("a", T.IntegerType())]), {"path": f"{tmp_path}/out"})
    seen = []

    def as_task(task):
        monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: task)))

    def rows(n, task):
        yield (n,)
        if task == 1:  # the second attempt starts and ends while the first one is writing
            as_task(2)
            seen.append(writer.write(rows(n, 2)))
        yield (n + 1,)

    as_task(1)
    first = writer.write(rows(7, 1))
    assert first.path != seen[0].path and first.rows == seen[0].rows == 2 and all(f.startswith(".") for f in names(f"{tmp_path}/out"))
    writer.commit([seen[0]])
    assert names(f"{tmp_path}/out") == ["_SUCCESS", "part-00000.xlsx"] and zipfile.ZipFile(f"{tmp_path}/out/part-00000.xlsx").testzip() is None


def test_failing_task(spark, reader, tmp_path):
    """A job whose task fails leaves no file, and what another job wrote stays."""
    good = spark.range(20).withColumn("t", F.lit("x")).repartition(3)
    good.write.format("xlsx").mode("append").save(f"{tmp_path}/out")
    before = {f: os.path.getsize(f"{tmp_path}/out/{f}") for f in names(f"{tmp_path}/out")}
    assert len(before) == 4
    bad = good.withColumn("t", F.when(F.col("id") == 13, "=1+1").otherwise("x"))  # a formula is refused in the middle of a file
    with pytest.raises(Exception, match="formula"):
        bad.write.format("xlsx").mode("append").save(f"{tmp_path}/out")
    assert {f: os.path.getsize(f"{tmp_path}/out/{f}") for f in names(f"{tmp_path}/out")} == before


def test_stream_sink(spark, reader, tmp_path):
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda: spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.format("xlsx").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination(120)
    run()
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert {f[:11] for f in names(f"{tmp_path}/out")} == {"batch-00000", "batch-00001"}
    found = reader(",".join(f"{tmp_path}/out/{f}" for f in names(f"{tmp_path}/out")))
    assert sorted(int(r.value) for r in found.where("row > 1").collect()) == list(range(15))


def test_filters_reach_the_file(spark, reader, tmp_path, monkeypatch):
    path = f"{tmp_path}/book.xlsx"
    tables = {f"s{i}": (["a", "b", "c"], iter([tuple(f"{i}-{r}-{c}" for c in "abc") for r in range(1, 51)])) for i in range(6)}
    xlsx.write_workbook(path, tables)
    book = reader(path)
    assert book.rdd.getNumPartitions() == 6 and book.count() == 6 * 51 * 3
    with zipfile.ZipFile(path) as z:  # a filter on one sheet opens no other: the others aren't readable any more
        parts = {n: z.read(n) for n in z.namelist()}
    with zipfile.ZipFile(f"{tmp_path}/broken.xlsx", "w") as z:
        for n, data in parts.items():
            z.writestr(n, b"<broken" if n.startswith("xl/worksheets/") and "sheet3" not in n else data)
    one = reader(f"{tmp_path}/broken.xlsx").where("sheet = 's2' and row between 3 and 4 and col >= 2")
    assert one.rdd.getNumPartitions() == 1
    assert sorted((r.row, r.col, r.value) for r in one.collect()) == [(r, c, f"2-{r - 1}-{x}") for r in (3, 4) for c, x in ((2, "b"), (3, "c"))]
    assert sorted({r.sheet for r in book.where("sheet in ('s1', 's4', 'none') and row in (1, 9) and col = 1").collect()}) == ["s1", "s4"]
    assert book.where("sheet in ('s1') and row in (1, 9, 30)").count() == 9 and book.where("row < 3 and col > 2").count() == 12 and book.where("value = '2-1-a'").count() == 1
    assert book.where("sheet = 's1' and sheet = 's2'").count() == 0
    with pytest.raises(Exception, match="broken|token|XML|element"):
        reader(f"{tmp_path}/broken.xlsx").count()


def test_replaced_files(spark, tmp_path):
    """An older file is replaced in one step; a stream that fails leaves it as it was."""
    path = f"{tmp_path}/f.bin"
    for data in (b"one", b"two"):
        files.put(spark, path, data)
        assert files.get(spark, path) == data

    class Torn:
        n = 0

        def read(self, size):
            self.n += 1
            if self.n > 1:
                raise ConnectionResetError
            return b"half"

    with pytest.raises(ConnectionResetError):
        files.put_stream(spark, path, Torn(), 100)
    assert files.get(spark, path) == b"two" and names(tmp_path) == ["f.bin"]

"""Merges into a partitioned table: what changes is rewritten, the rest keeps its files."""

import pytest
from pyspark.sql import functions as F

from tallow.sources.merge import Conflict, MergeTable

ROWS = "k long, day string, v double, note string"


@pytest.fixture
def stored(spark, tmp_path):
    t = MergeTable(spark, str(tmp_path / "table"), ("k", "day"), ("day",))
    rows = spark.range(400).select("id", F.concat(F.lit("d"), (F.col("id") % 20).cast("string")).alias("day"), F.col("id").cast("double").alias("v"), F.lit("é").alias("note")).withColumnRenamed("id", "k")
    assert t.merge(rows) == 1
    return t, rows


def test_one_partition_of_twenty_changes(spark, stored):
    t, rows = stored
    before, old = t.manifest()["parts"], t.read()
    assert len(before) == 20
    assert t.merge(spark.createDataFrame([(7, "d7", -1.0, "new"), (1007, "d7", 5.0, None)], ROWS)) == 2
    after = t.manifest()["parts"]
    assert {p for p in after if after[p] != before[p]} == {"day=d7"}
    now = {(r.k, r.day): (r.v, r.note) for r in t.read().collect()}
    assert len(now) == 401 and now[7, "d7"] == (-1.0, "new") and now[1007, "d7"] == (5.0, None) and now[8, "d8"] == (8.0, "é")
    # A reader from before keeps what it saw, and the version can be read again.
    assert old.count() == 400 and old.where("v < 0").count() == 0
    assert t.read(1).count() == 400 and t.read().where("day = 'd7'").count() == 21


def test_a_repeated_load_changes_nothing(spark, stored):
    t, rows = stored
    before = t.manifest()
    assert t.merge(rows) == 1 and t.merge(rows.where("k < 30")) == 1 and t.merge(rows.where("false")) == 1
    assert t.manifest() == before and t.versions() == [1]
    # One row of many that differs rewrites its own partition alone.
    assert t.merge(rows.withColumn("v", F.when(F.col("k") == 3, 0.5).otherwise(F.col("v")))) == 2
    assert sum(f != before["parts"][p] for p, f in t.manifest()["parts"].items()) == 1


def test_only_touched_partitions_are_read(spark, stored):
    t, _ = stored
    files = t._rows(t.manifest(), {"day=d3"}).inputFiles()
    assert files and all("/day=d3/" in f for f in files)


def test_nulls_and_odd_values_as_keys_and_partitions(spark, tmp_path):
    t = MergeTable(spark, str(tmp_path / "odd"), ("k", "day"), ("day",))
    t.merge(spark.createDataFrame([(None, None, 1.0, "a"), (1, "a/b=c d", 2.0, None), (1, "a/b=c d", 1.0, None)], ROWS))
    assert sorted((str(r.k), r.day, r.v) for r in t.read().collect()) == [("1", "a/b=c d", 2.0), ("None", None, 1.0)]
    t.merge(spark.createDataFrame([(None, None, 9.0, "a"), (2, "a/b=c d", 4.0, None)], ROWS))
    assert sorted((str(r.k), r.day, r.v) for r in t.read().collect()) == [("1", "a/b=c d", 2.0), ("2", "a/b=c d", 4.0), ("None", None, 9.0)]


def test_a_second_writer_of_one_version_is_refused(spark, stored, monkeypatch):
    t, rows = stored
    stale = t.manifest()
    t.merge(rows.where("k = 1").withColumn("v", F.lit(0.0)))
    late = MergeTable(spark, t.path, t.keys, t.partition)
    monkeypatch.setattr(late, "manifest", lambda version=None: stale)
    with pytest.raises(Conflict):
        late.merge(rows.where("k = 2").withColumn("v", F.lit(0.0)))
    assert t.read().where("k = 1").first().v == 0.0 and t.read().where("k = 2").first().v == 2.0


def test_a_half_written_manifest_is_not_seen(spark, stored):
    t, _ = stored
    where, fs = t._at("manifests", "2")
    out = fs.create(where, False)
    out.write(bytearray(b'{"version": 2, "par'))
    out.close()
    assert t.manifest()["version"] == 1 and t.read().count() == 400
    # Its writer may still be at work, so that version is taken until it is cleared away.
    one = spark.createDataFrame([(7, "d7", -1.0, "new")], ROWS)
    with pytest.raises(Conflict):
        t.merge(one)
    t.vacuum()
    assert t.merge(one) == 2


def test_vacuum_keeps_the_newest(spark, stored):
    t, rows = stored
    t.merge(rows.where("k % 20 < 3").withColumn("v", F.col("v") + 1))
    assert t.vacuum() == 3 and t.versions() == [2]
    assert t.read().count() == 400 and t.read().where("v <> k").count() == 60
    with pytest.raises(FileNotFoundError):
        MergeTable(spark, t.path + "-none", ("k",), ("day",)).read()


def test_two_partition_columns(spark, tmp_path):
    t = MergeTable(spark, str(tmp_path / "two"), ("k", "day", "note"), ("note", "day"))
    rows = spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("day"), F.lit(1.0).alias("v"), (F.col("id") % 2).cast("string").alias("note"))
    assert t.merge(rows) == 1 and len(t.manifest()["parts"]) == 6
    assert t.merge(rows.where("k = 5").withColumn("v", F.lit(2.0))) == 2
    assert t.read().count() == 60 and t.read().agg(F.sum("v")).first()[0] == 61.0

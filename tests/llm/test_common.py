"""Shared storage of intermediates, and dealing of small tables."""

import os

import pytest

from verdex.llm import common
from verdex.operators.lookups import spread


def test_scratch_tables_go_but_for_the_kept(spark):
    before = list(common.WRITTEN)
    with common.Scratch(spark) as scratch:
        inner = common.materialize(spark.range(5), "inner")
        with common.Scratch(spark) as nested:
            deep = nested.keep(inner.where("id > 1"), "deep")
        out = scratch.keep(deep.where("id > 2"), "out")
    assert sorted(r["id"] for r in out.collect()) == [3, 4]
    written = common.WRITTEN[len(before) :]
    assert common.WRITTEN[: len(before)] == before and len(written) == 1 and "out" in written[0]
    assert os.path.isdir(written[0].removeprefix("file://").replace("file:", ""))
    common.remove(spark, written)
    with pytest.raises(Exception, match="(?i)exist|path"):
        inner.collect()


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_small_tables_in_one_file_are_dealt_out(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    spark.range(100).repartition(8).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert spread(many) is many
    assert sorted(r["id"] for r in spread(one).collect()) == list(range(100))


def test_operators_leave_no_settings_behind(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    from verdex.llm import bpe

    assert bpe.encode(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).count() == 1
    assert spark.conf.get(name) == before

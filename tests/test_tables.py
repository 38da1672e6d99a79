import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from boutlab.session import scratch_path
from boutlab.sources import tables


def _shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {str(f) for top in manager.localDirs() for f in Path(top.getPath()).rglob("shuffle_*.data")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    """The files of its write go when it ends, and the setting is as before, also after a write that fails."""
    setting = spark.conf.get(tables.REMOVE_SHUFFLES, "false")
    before = _shuffle_files(spark)
    rows = spark.range(10_000).withColumn("k", F.col("id") % 700)
    stored = tables.save_snapshot(rows.repartition(3, "k").groupBy("k").count(), scratch_path(spark, "counted"))
    until = time.time() + 20
    while (left := _shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert stored.count() == 700 and stored.agg(F.sum("count")).first()[0] == 10_000
    failing = spark.range(1).select(F.raise_error(F.lit("no such row")).alias("x"))
    with pytest.raises(Exception, match="no such row"):
        tables.save_snapshot(failing, scratch_path(spark, "failed"))
    assert spark.conf.get(tables.REMOVE_SHUFFLES, "false") == setting

import gc
import os
import re
import time

from pyspark.sql import functions as F
from tracewake.session import SHUFFLES_GO, cut_lineage


def test_checkpoints_go_with_the_frames_that_read_them(spark):
    kept = cut_lineage(spark.range(10))
    cut = cut_lineage(spark.range(1000))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = len(os.listdir(folder))
    assert cut.count() == 1000 and before >= 2
    del cut
    for _ in range(40):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.25)
        if len(os.listdir(folder)) < before:
            break
    assert len(os.listdir(folder)) < before and kept.count() == 10


def test_shuffle_files_go_with_the_step_that_made_them(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {name for name in re.findall(r"[^/\n]+$", manager.getAllFiles().mkString("\n"), re.M) if name.startswith("shuffle")}
    df = spark.range(5000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
    before, setting = files(), spark.conf.get(SHUFFLES_GO, None)
    cut = cut_lineage(df)
    for _ in range(40):
        if not files() - before:
            break
        time.sleep(0.25)
    assert not files() - before and spark.conf.get(SHUFFLES_GO, None) == setting
    assert cut.count() == 7 and df.count() == 7

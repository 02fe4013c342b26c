from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def make_spark():
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="finledger-test-")
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("finledger-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # skip the per-call Python call-site capture (several JVM round trips per
        # DataFrame/Column call while a plan is being built)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
        # tests run without a cluster: the shared checkpoint folder is a scratch one
        .config("spark.checkpoint.dir", os.path.join(scratch, "checkpoint"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        ck = os.path.join(scratch, "checkpoint")
        spark.conf.set("spark.checkpoint.dir", ck)
        spark.sparkContext.setCheckpointDir(ck)
    return spark


@pytest.fixture(scope="session")
def spark():
    s = make_spark()
    yield s
    s.stop()

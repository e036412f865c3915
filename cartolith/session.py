"""A local session for tests and the bench; a cluster brings its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: str | None = None, shuffle: int = 8) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("cartolith")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(shuffle)).config("spark.sql.adaptive.enabled", "true")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")   # call-site capture makes plan building slow
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.warehouse.dir", os.environ.get("CARTOLITH_WAREHOUSE", "/tmp/cartolith-warehouse"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark

"""Session and table helpers shared by every part of the library."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "strataleaf") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@contextmanager
def work_folder(spark: SparkSession) -> Iterator[str]:
    """A new folder that driver and executors share, below spark.checkpoint.dir (set here only where unset, on a single machine); deleted at the end."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file:///tmp/checkpoints/{os.getpid()}"
    made = f"{shared.rstrip('/')}/work-{uuid.uuid4().hex}"
    try:
        yield made
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(made)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one parquet table of a dataset folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

"""Small helpers that several operators share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (held := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = held.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file:///tmp/checkpoints/{os.getpid()}"
    return found.rstrip("/")


def scratch_folder(spark: SparkSession) -> str | None:
    """The shared folder as a path that tasks can open; None (a task's own folder, as for Spark's spills) if it is in a store without paths."""
    folder = shared_folder(spark)
    path = folder.removeprefix("file:")
    return "/" + path.lstrip("/") if folder.startswith("file:") or "://" not in folder else None


def written(df: DataFrame, name: str, partitioned: str | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    to = df.write.mode("overwrite").option("compression", "zstd")
    (to.partitionBy(partitioned) if partitioned else to).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what written() made, once nothing reads it any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


FILTER_BITS = 1 << 26
_BUCKET_BITS = 1 << 15


def split_by_ids(df: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose id is certainly not among ids, the other rows), without a shuffle of df.

    The ids set bits of a filter of 8 MB, whatever their number, which is broadcast; the more
    ids, the more rows land in the second part, which is to be joined with the ids themselves.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = (
        ids.select(place(F.col(column).cast("long")).alias("_h"))
        .groupBy((F.col("_h") / _BUCKET_BITS).cast("long").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.col("_h") % _BUCKET_BITS).alias("_bits"))
    )
    bits = written(bits, "filter")  # both parts read it
    held = df.withColumn("_h", place(F.col(column).cast("long"))).withColumn("_bucket", (F.col("_h") / _BUCKET_BITS).cast("long"))
    joined = held.join(F.broadcast(bits), "_bucket", "left")
    at = (F.col("_h") % _BUCKET_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr("cast(shiftleft(1, cast(_h % 8 as int)) as int)")) != 0, F.lit(False))
    marked = joined.withColumn("_hit", hit)
    return marked.where("NOT _hit").select(df.columns), marked.where("_hit").select(df.columns)


def only_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id is among ids; only rows that pass the filter are shuffled."""
    return split_by_ids(df, ids, column)[1].join(ids.select(column), column, "left_semi").select(df.columns)


def without_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id is not among ids; only rows that pass the filter are shuffled."""
    sure, open_ = split_by_ids(df, ids, column)
    return sure.unionByName(open_.join(ids.select(column), column, "left_anti").select(df.columns))


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about most_bytes of text; one longer text is a batch by itself."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        at, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < len(sizes):
            yield batch.slice(at)

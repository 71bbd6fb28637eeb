"""Path lists and configuration files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    """path column of a text file with one path a line; blank lines and lines that begin with # are skipped."""
    return meaningful(spark.read.text(path).withColumnRenamed("value", "line"))


def meaningful(lines: DataFrame) -> DataFrame:
    stripped = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    return lines.withColumn("path", stripped).where((F.col("path") != "") & ~F.col("path").startswith("#"))


def checked_path_list(path: str) -> list[str]:
    """Paths of a local list file; a missing path fails with its line number, an empty list too."""
    out = []
    with open(path, encoding="utf-8") as f:
        for number, line in enumerate(f, 1):
            if (p := line.strip()) and not p.startswith("#"):
                if not os.path.exists(p):
                    raise FileNotFoundError(f"line {number}: no such file: {p}")
                out.append(p)
    if not out:
        raise ValueError("the list names no path")
    return out


def one_source(inline: list[str], list_file: str | None) -> list[str]:
    """Paths given inline or in a list file; exactly one of the two must be given."""
    if bool(inline) == bool(list_file):
        raise ValueError("give either paths or a list file")
    return list(inline) if inline else checked_path_list(list_file)

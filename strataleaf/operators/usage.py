"""Token usage: a log of calls, its sums and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls (input_tokens, output_tokens, ordinal) with call_number from 1 in each group."""
    order = Window.partitionBy(*keys).orderBy("ordinal")
    return calls.withColumn("call_number", F.row_number().over(order).cast("long"))


def total(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of a log; combining two logs is summing their union."""
    return calls.groupBy(*keys).agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("output_tokens"),
        F.count("*").alias("llm_calls"),
    ).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def report(totals: DataFrame, keys: list[str]) -> DataFrame:
    """A line for each group, numbers with separators."""
    n = lambda c: F.format_number(F.col(c), 0)
    line = F.concat(F.lit("calls: "), n("llm_calls"), F.lit(", input: "), n("input_tokens"), F.lit(", output: "), n("output_tokens"), F.lit(", total: "), n("total_tokens"))
    return totals.select(*keys, line.alias("line"))

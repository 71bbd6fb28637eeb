"""Bulk file renames: plan as DataFrames, apply in order."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.functions.text import format_confidence


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The folder of a path with its last slash; empty for a bare name."""
    return F.regexp_replace(path, "[^/]*$", "")


def paths_with_names(paths: DataFrame) -> DataFrame:
    return paths.withColumn("filename", basename(F.col("path")))


def duplicate_names(paths: DataFrame) -> DataFrame:
    """filename, n of the names that more than one path has."""
    return paths_with_names(paths).groupBy("filename").agg(F.count("*").alias("n")).where("n > 1")


def checked_paths(paths: DataFrame) -> DataFrame:
    """paths with names, failing where a name is not unique, since an operation would be ambiguous."""
    same = F.count("*").over(Window.partitionBy("filename"))
    bad = F.raise_error(F.concat(F.lit("duplicate filename: "), F.col("filename")))
    return paths_with_names(paths).withColumn("filename", F.when(same > 1, bad).otherwise(F.col("filename")))


def valid_operations(ops: DataFrame) -> DataFrame:
    """Operations, failing where a confidence lies outside 0 to 1."""
    bad = F.raise_error(F.format_string("confidence out of range: %s", F.col("confidence").cast("string"))).cast("double")
    return ops.withColumn("confidence", F.when(F.col("confidence").between(0.0, 1.0), F.col("confidence")).otherwise(bad))


def resolve(ops: DataFrame, paths: DataFrame) -> DataFrame:
    """ordinal, source, target of the operations whose file is known and whose name changes."""
    named = paths.select("path", "filename")
    target = F.concat(parent(F.col("path")), F.col("output_filename"))
    joined = ops.join(named, F.col("input_filename") == F.col("filename"))
    return joined.select("ordinal", F.col("path").alias("source"), target.alias("target")).where("source != target")


def merge(batched: DataFrame) -> DataFrame:
    """Operations of all batches, the earliest for each input; their order stays."""
    first = Window.partitionBy("input_filename").orderBy("batch_ix", "ordinal")
    return batched.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def confidence_bucket(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "green").when(confidence >= 0.7, "yellow").otherwise("red")


def preview(ops: DataFrame, reasoning_chars: int = 50) -> DataFrame:
    """Rows as a reviewer sees them."""
    why = F.coalesce("reasoning", F.lit(""))
    short = F.when(F.length(why) > reasoning_chars, F.concat(F.substring(why, 1, reasoning_chars), F.lit("..."))).otherwise(why)
    return ops.select("ordinal", "input_filename", "output_filename", format_confidence(F.col("confidence")).alias("confidence"), confidence_bucket(F.col("confidence")).alias("colour"), short.alias("reasoning"))


def display(resolved: DataFrame, ops: DataFrame, reasoning_chars: int = 50) -> DataFrame:
    """Resolved renames with what the last operation on the source's name says of them; N/A where there is none."""
    last = ops.groupBy("input_filename").agg(F.max_by(F.struct("confidence", "reasoning"), "ordinal").alias("op"))
    shown = resolved.withColumn("input_filename", basename(F.col("source"))).join(last, "input_filename", "left")
    percent = F.concat(F.rint(F.col("op.confidence") * 100).cast("long").cast("string"), F.lit("%"))
    why = F.coalesce("op.reasoning", F.lit(""))
    short = F.when(F.length(why) > reasoning_chars, F.concat(F.substring(why, 1, reasoning_chars), F.lit("..."))).otherwise(why)
    return shown.select("ordinal", "source", "target", F.coalesce(percent, F.lit("N/A")).alias("confidence"), F.coalesce(confidence_bucket(F.col("op.confidence")), F.lit("red")).alias("colour"), short.alias("reasoning"))


def result_length(ops: DataFrame) -> DataFrame:
    """n_operations of a rename result."""
    return ops.agg(F.count("*").alias("n_operations"))


def operation_string() -> Column:
    """An operation as inference logs count it."""
    return F.format_string("RenameOp('%s' -> '%s', confidence=%s)", "input_filename", "output_filename", F.col("confidence").cast("string"))


def planned_outcome(resolved: DataFrame, existing: DataFrame) -> DataFrame:
    """status and error of each rename as applying them in order would give, without touching files.

    Sequential effects follow from the order of operations: a path exists before an operation if the
    last earlier event on it created it, or if there is none and it existed at first. Only operations
    whose files no other operation touches are decided here; the rest are marked `sequential`.
    """
    touched = resolved.select(F.explode(F.array("source", "target")).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    have = existing.select(F.col("path").alias("p")).distinct().withColumn("there", F.lit(True))
    known = touched.join(have, "p", "left")
    s = known.select(F.col("p").alias("source"), F.col("n").alias("sn"), F.coalesce("there", F.lit(False)).alias("s_there"))
    t = known.select(F.col("p").alias("target"), F.col("n").alias("tn"), F.coalesce("there", F.lit(False)).alias("t_there"))
    status = F.when((F.col("sn") > 1) | (F.col("tn") > 1), "sequential").when(~F.col("s_there"), "failed").when(F.col("t_there"), "failed").otherwise("ok")
    error = F.when(F.col("status") == "failed", F.when(~F.col("s_there"), "source does not exist").otherwise("target already exists"))
    return resolved.join(s, "source").join(t, "target").withColumn("status", status).withColumn("error", error).select("ordinal", "source", "target", "status", "error")


def outcome_counts(results: DataFrame) -> DataFrame:
    """success_count, failure_count, all_succeeded."""
    return results.agg(
        F.count_if(F.col("status") == "ok").alias("success_count"),
        F.count_if(F.col("status") == "failed").alias("failure_count"),
        F.coalesce(F.bool_and(F.col("status") != "failed"), F.lit(True)).alias("all_succeeded"),
    )


def apply_renames(pairs: list[tuple[str, str]], move: Callable[[str, str], None] = os.rename) -> list[tuple[str, str, str, str | None]]:
    """Renames files one after the other, for effects depend on order; (source, target, status, error) of each."""
    out: list[tuple[str, str, str, str | None]] = []
    for source, target in pairs:
        error = None
        if not os.path.exists(source):
            error = "source does not exist"
        elif os.path.exists(target):
            error = "target already exists"
        else:
            try:
                move(source, target)
            except OSError as e:
                error = str(e)
        out.append((source, target, "failed" if error else "ok", error))
    return out

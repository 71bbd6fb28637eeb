"""Inference behind a barrier: requests, provider, retries, results.

A provider is any callable from a system prompt and a text to a list of rows.
infer() runs it once for each request and writes the rows before anything reads
them, so lazy evaluation, recomputation or a second action never calls it again.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attempts and waits in seconds.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 5, 10.0, 120.0
#: Class names of errors that a second attempt does not mend.
FINAL_ERRORS = ("ContextOverflow", "BadRequest", "InvalidRequest", "ValidationError")
#: Seconds between requests for contents and for names.
TOC_DELAY, RENAME_DELAY = 10.0, 2.0
ENTRY_SCHEMA = "array<struct<title:string,page_number:int,level:int,confidence:double>>"
RENAME_SCHEMA = "array<struct<input_filename:string,output_filename:string,confidence:double,reasoning:string>>"
Provider = Callable[[str, str], list[dict]]

TOC_PROMPT = "List the headings of this document as entries with title, page_number, level and confidence."
CONTINUE_PROMPT = "Continue the list of headings with this next part of the same document."
REFINE_PROMPT = "Correct and complete these entries with the printed contents and the features given."
RENAME_PROMPT = "Propose a new file name for each name listed, following the instruction."


def is_retryable(error: Exception) -> bool:
    """A status of 429 or 500 and above; without a status, any class name but the final ones."""
    status = getattr(error, "status_code", None)
    if isinstance(status, int):
        return status == 429 or status >= 500
    return not any(name in type(error).__name__ for name in FINAL_ERRORS)


def with_retry(call: Callable[[], list[dict]], retryable: Callable[[Exception], bool] = is_retryable, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep, log: Callable[[str], None] = lambda _: None) -> list[dict]:
    """The call's result; waits between attempts double from 10 to 120 seconds."""
    wait = FIRST_WAIT
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:
            if attempt == attempts or not retryable(e):
                raise
            log(f"attempt {attempt}/{attempts} failed ({e}); next in {wait:.0f} s")
            sleep(wait)
            wait = min(wait * 2, LONGEST_WAIT)
    raise AssertionError("unreachable")


def requests(batches: DataFrame, first: str = TOC_PROMPT, following: str = CONTINUE_PROMPT) -> DataFrame:
    """doc_id, batch_ix, system, text of batches (doc_id, batch_ix, batches, text)."""
    said = F.when(F.col("batch_ix") > 1, F.format_string("batch %d of %d\n", "batch_ix", "batches")).otherwise(F.lit(""))
    return batches.select("doc_id", "batch_ix", F.when(F.col("batch_ix") == 1, first).otherwise(following).alias("system"), F.concat(said, F.col("text")).alias("text"))


def infer(wanted: DataFrame, provider: Provider, schema: str, path: str, delay: float = 0.0, retryable: Callable[[Exception], bool] = is_retryable, log: Callable[[str], None] | None = None) -> DataFrame:
    """Rows of the provider for each request, written to path; with a delay, requests go one after the other.

    Failed attempts are told to log, by default a warning of the worker's logger.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tell, asked_before = log or logging.getLogger("strataleaf").warning, False
        for part in parts:
            rows = []
            for doc_id, batch_ix, system, text in part[["doc_id", "batch_ix", "system", "text"]].itertuples(index=False):
                if delay and asked_before:
                    time.sleep(delay)
                asked_before = True
                found = with_retry(lambda s=system, t=text: provider(s, t), retryable, log=tell)
                rows.append((doc_id, batch_ix, json.dumps(found)))
            yield pd.DataFrame(rows, columns=["doc_id", "batch_ix", "answer"])

    asked = wanted.coalesce(1) if delay else wanted
    answers = asked.mapInPandas(run, "doc_id long, batch_ix long, answer string")
    answers.write.mode("overwrite").parquet(path)
    kept = wanted.sparkSession.read.parquet(path)
    return kept.select("doc_id", "batch_ix", F.posexplode(F.from_json("answer", schema)).alias("pos", "row")).select("doc_id", "batch_ix", (F.col("pos") + 1).cast("long").alias("ordinal"), "row.*")


def heading_provider(system: str, text: str) -> list[dict]:
    """Deterministic stand-in: bold or larger-than-most lines of a compact text become entries, levels by size."""
    page, rows = 1, []
    for line in text.splitlines():
        if line.startswith("P") and line.endswith(":") and line[1:-1].isdigit():
            page = int(line[1:-1])
        elif line.startswith("F") and "|" in line:
            part = line.split("|")
            try:
                rows.append((page, float(part[1]), part[2], part[-1] == "B"))
            except (IndexError, ValueError):
                continue
    if not rows:
        return []
    sizes = [r[1] for r in rows]
    body = max(sorted(set(sizes)), key=sizes.count)
    heads = [r for r in rows if (r[1] >= body * 1.15 or r[3] and r[1] >= body) and 3 <= len(r[2].strip()) <= 200]
    ranks = {s: i + 1 for i, s in enumerate(sorted({h[1] for h in heads}, reverse=True))}
    return [{"title": h[2].strip(), "page_number": h[0], "level": ranks[h[1]], "confidence": 1.0} for h in heads]

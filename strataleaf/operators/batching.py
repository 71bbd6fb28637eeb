"""Greedy batches under a token budget.

The running sum starts anew whenever a batch is full, which no window frame can
say; the costs of one group are folded in order, in one pass over two numbers a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.functions.text import proxy_tokens

#: Budgets in tokens and what prompts take of them.
FEATURE_TOKENS, FEATURE_OVERHEAD, OVERLAP_BLOCKS = 100_000, 3_000, 5
NAME_TOKENS, NAME_OVERHEAD = 50_000, 2_000


def greedy_batches(rows: DataFrame, key: str, order: str, cost: Column, budget: int) -> DataFrame:
    """rows with batch_ix from 1: a new batch begins where the next row would exceed the budget."""
    kinds = dict(rows.dtypes)

    def run(group: pa.Table) -> pa.Table:
        batch, used, out = 1, 0, []
        group = group.sort_by([("o", "ascending"), ("c", "ascending")])
        for c in group.column("c").to_pylist():
            c = c or 0
            if used + c > budget and used > 0:
                batch, used = batch + 1, 0
            used += c
            out.append(batch)
        return pa.table({key: group.column(key), order: group.column("o"), "batch_ix": pa.array(out, pa.int64())})

    costs = rows.select(key, F.col(order).cast("long").alias("o"), cost.cast("long").alias("c"))
    placed = costs.groupBy(key).applyInArrow(run, f"`{key}` {kinds[key]}, `{order}` long, batch_ix long")
    return rows.join(placed, [key, order])


def name_batches(names: DataFrame, key: str, order: str, max_tokens: int = NAME_TOKENS, tokens: Callable[[Column], Column] = proxy_tokens) -> DataFrame:
    """File names in batches; a name costs its list line."""
    line = F.concat(F.lit("- "), F.col("name"), F.lit("\n"))
    return greedy_batches(names, key, order, tokens(line), max_tokens - NAME_OVERHEAD)


def files_before(batches: DataFrame, key: str) -> DataFrame:
    """batch_ix, size and the number of rows in earlier batches of the group."""
    sizes = batches.groupBy(key, "batch_ix").agg(F.count("*").alias("size"))
    before = Window.partitionBy(key).orderBy("batch_ix").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("files_before", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))


def proxy_count(text: str) -> int:
    return math.ceil(len(text) / 4)


def overlapping_batches(block_tokens: list[int], measure: Callable[[int, int], int], budget: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) of each batch of blocks; measure(first, end) counts the blocks that a batch starts with."""
    out: list[tuple[int, int]] = []
    first, used = 0, 0
    for at, tokens in enumerate(block_tokens):
        if used + tokens > budget and at > first:
            out.append((first, at))
            first = max(first, at - overlap)
            used = measure(first, at)
        used += tokens
    return [*out, (first, len(block_tokens))] if block_tokens else [(0, 0)]


def feature_batches(lines: DataFrame, max_tokens: int = FEATURE_TOKENS, overlap: int = OVERLAP_BLOCKS, count: Callable[[str], int] = proxy_count) -> DataFrame:
    """doc_id, batch_ix, first, end (block numbers) from serialize.feature_lines().

    A batch after the first begins with the last blocks of the one before, measured anew in
    serialised form, so the fold needs the text itself and runs per document on Arrow tables.
    """
    budget = max_tokens - FEATURE_OVERHEAD

    def run(rows: pa.Table) -> pa.Table:
        names = ["page_number", "phase", "block_ix", "line_ix", "span_ix", "font", "text_snippet", "line"]
        spans = sorted(zip(*(rows.column(n).to_pylist() for n in names), strict=True), key=lambda r: r[:5])
        blocks = [list(g) for _, g in groupby(spans, key=lambda r: r[:3])]
        cost = [max(1, count("\n".join(["P1:", *(f"F0|12|{r[6]}|.12|B" for r in g)]))) for g in blocks]

        def measure(first: int, end: int) -> int:
            fonts: dict[str, int] = {}
            pages: dict[int, list[str]] = {}
            for r in chain.from_iterable(blocks[first:end]):
                no = fonts.setdefault(r[5], len(fonts))
                pages.setdefault(r[0], []).append(f"F{no}|" + r[7].split("|", 1)[1])
            head = ["FONTS:", *(f"F{i}={f}" for f, i in fonts.items()), ""]
            return count("\n".join([*head, *(x for p in sorted(pages) for x in [f"P{p}:", *pages[p]])]))

        found = overlapping_batches(cost, measure, budget, overlap)
        columns = ([rows.column("doc_id")[0].as_py()] * len(found), range(1, len(found) + 1), [f for f, _ in found], [e for _, e in found])
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "batch_ix", "first", "end"), columns, strict=True)})

    kept = ["doc_id", "page_number", "phase", "block_ix", "line_ix", "span_ix", "font", "text_snippet", "line"]
    return lines.select(*kept).groupBy("doc_id").applyInArrow(run, "doc_id long, batch_ix long, first long, end long")

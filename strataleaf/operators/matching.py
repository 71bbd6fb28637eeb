"""Joins of texts of which one contains the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shorter texts than this match nothing here.
GRAM = 8


def _grams(text: Column) -> Column:
    """All distinct substrings of eight characters; none of a shorter text."""
    places = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - (GRAM - 1)))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM))))


def containment_join(left: DataFrame, right: DataFrame, on: list[str], l_text: str, r_text: str) -> DataFrame:
    """Rows of left and right, equal on `on`, whose texts are equal or one within the other, each pair once.

    What contains a text holds its first eight characters, so pairs meet by an equi-join on these
    instead of all with all; columns other than `on` must have different names.
    """
    parts = []
    for outer, inner, o, i, size in ((left, right, l_text, r_text, ">="), (right, left, r_text, l_text, ">")):
        grams = outer.where(F.length(o) >= GRAM).withColumn("_gram", F.explode(_grams(F.col(o))))
        heads = inner.where(F.length(i) >= GRAM).withColumn("_gram", F.substring(i, 1, GRAM))
        # Merged: Spark guesses the size of computed texts from that of the files they come from, and would broadcast large tables.
        met = grams.join(heads.hint("merge"), [*on, "_gram"]).where(F.expr(f"length({o}) {size} length({i})") & F.col(o).contains(F.col(i)))
        parts.append(met.drop("_gram"))
    return parts[0].unionByName(parts[1])

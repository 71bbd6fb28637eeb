"""Token counts with a vocabulary, where proxy_tokens is not exact enough.

A vocabulary is named by the path of a tokenizers JSON file, which every executor
can open, or by the name of a tiktoken encoding. Each process loads it once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the encoding that prompts are counted in.
PROMPT_ENCODING = "o200k_base"


@cache
def encoder(vocabulary: str) -> Callable[[str], list[int]]:
    """Text to ids; special strings in a text are text."""
    if vocabulary.endswith(".json"):
        from tokenizers import Tokenizer

        held = Tokenizer.from_file(vocabulary)
        held.encode_special_tokens = True
        return lambda text: held.encode(text, add_special_tokens=False).ids
    import tiktoken

    return tiktoken.get_encoding(vocabulary).encode_ordinary


def text_counter(vocabulary: str = PROMPT_ENCODING) -> Callable[[str], int]:
    """Tokens of one text, for operators that count inside a task."""
    return lambda text: len(encoder(vocabulary)(text))


def vocabulary_tokens(vocabulary: str = PROMPT_ENCODING) -> Callable[[Column], Column]:
    """Tokens of a column, in place of proxy_tokens; a null text has none."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(vocabulary)
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count

"""Exact token counts at every prefix, for questions about budgets and cuts.

``with_prefix_counts`` stores for each text how the token count changes at each
character; its running sums are the counts of all prefixes, as the vocabulary's
own library gives them for the prefix alone. Counts, the longest prefix within
a budget and the count of any prefix are then read off, and nothing is encoded
again.

A NULL or empty text has no steps, no tokens and an empty longest prefix. Rows,
also repeated ones, stay as they are; white space alone has no tokens.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import counter
from .common import append_columns, text_of

STEPS = "prefix_steps"
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def with_prefix_counts(df: DataFrame, text: str, path: str, out: str = STEPS) -> DataFrame:
    """Add the changes of the token count at each character, as little-endian 16-bit numbers."""

    def work(columns: list[list]) -> list[list]:
        return [counter(path).steps([t or "" for t in columns[0]])]

    return append_columns(df, [text], work, f"{out} binary")


def prefix_counts(steps: bytes | None) -> np.ndarray:
    """Token counts of the prefixes of 1, 2, ... characters."""
    return np.frombuffer(steps or b"", "<i2").cumsum(dtype=np.int64)


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    if not len(counts) or counts[-1] <= budget:
        return len(counts)
    fitting = np.flatnonzero(counts <= budget)
    return int(fitting[-1]) + 1 if len(fitting) else 0


def answered(all_steps: list[bytes | None], budget: int) -> list[list[int]]:
    """Token counts of whole texts, and characters of the longest prefix within the budget."""
    totals, fitting = [], []
    for raw in all_steps:
        whole = np.frombuffer(raw or b"", "<i2")
        total = int(whole.sum(dtype=np.int64))
        totals.append(total)
        fitting.append(len(whole) if total <= budget else longest_within(prefix_counts(raw), budget))
    return [totals, fitting]


ANSWERS = "n_tokens bigint, fitting_chars bigint"


def answers(df: DataFrame, budget: int, steps: str = STEPS) -> DataFrame:
    """Replace stored steps by ``n_tokens`` and ``fitting_chars``, the longest prefix within the budget."""
    return append_columns(df, [steps], lambda columns: answered(columns[0], budget), ANSWERS).drop(steps)


def count_at(df: DataFrame, chars: str, steps: str = STEPS, out: str = "tokens_at") -> DataFrame:
    """Add the token count of the prefix of as many characters as column ``chars`` says."""

    def work(columns: list[list]) -> list[list]:
        found = []
        for raw, n in zip(*columns):
            whole = np.frombuffer(raw or b"", "<i2")
            found.append(int(whole[: max(0, n or 0)].sum(dtype=np.int64)))
        return [found]

    return append_columns(df, [steps, chars], work, f"{out} bigint")


def cut_to_budget(text: Column, fitting_chars: Column) -> Column:
    """The longest prefix of a text within the budget."""
    return F.substring(text, F.lit(1), fitting_chars.cast("int"))


def token_digest(documents: DataFrame, path: str, limit: int) -> DataFrame:
    """Size and token count of every text, and how much of it fits the limit."""
    rows = documents.select("doc_id", text_of("text").alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))

    def work(columns: list[list]) -> list[list]:
        # The tables of prefixes are made and read in one go; they needn't leave the task.
        return answered(counter(path).steps([t or "" for t in columns[0]]), limit)

    counted = append_columns(rows, ["text"], work, ANSWERS)
    return counted.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fitting_chars"
    )

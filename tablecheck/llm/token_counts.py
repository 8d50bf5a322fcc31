"""Token counts without token ids.

In each block of rows the pieces of every distinct pre-token are counted once. The counts
are joined by pre-token number to the pre-token frequencies of the documents and summed.
Pre-tokens of a corpus number nearly as many as its texts are long, so a join across
blocks would move as much as the texts; within a block nothing is moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.llm.bpe import (
    Codes, blocks, byte_symbols, load_merges, read_vocabulary, word_splitter,
)
from tablecheck.llm.helpers import named


def count_block(texts: list[str], split, pieces) -> np.ndarray:
    """Tokens of each text: frequencies of its pre-tokens times the pieces of each."""
    codes = Codes()
    documents, words, times = [], [], []
    for i, text in enumerate(texts):
        word, count = np.unique(
            np.fromiter(map(codes.__getitem__, split(text)), np.int32), return_counts=True
        )
        documents.append(np.full(len(word), i, np.int32))
        words.append(word)
        times.append(count)
    per_word = pieces(list(codes))
    if not len(per_word):
        return np.zeros(len(texts), np.int64)
    joined = per_word[np.concatenate(words)] * np.concatenate(times)
    totals = np.bincount(np.concatenate(documents), weights=joined, minlength=len(texts))
    return totals.astype(np.int64)


def count_column(text: Column, source: str) -> Column:
    """Tokens of ``text`` by the tokenizer file whose text is ``source``."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(source)
        special = load_merges(source).special
        split = word_splitter(special)

        model, symbols = tokenizer.model, byte_symbols()

        def pieces(words: list[str]) -> np.ndarray:
            # A pre-token needs no more than the model; special tokens are one piece.
            shown = (w.encode().decode("latin-1").translate(symbols) for w in words)
            counts = (1 if w in special else len(model.tokenize(s)) for w, s in zip(words, shown))
            return np.fromiter(counts, np.int64, len(words))

        for batch in batches:
            texts = (v.as_py() for v in batch)
            counts = [count_block(block, split, pieces) for block in blocks(texts)]
            yield pa.array(np.concatenate(counts) if counts else [], pa.int64())

    return F.arrow_udf(count, T.LongType())(text)


def count_tokens(
    df: DataFrame, tokenizer: str, text_col: str = "text", count_col: str = "n_tokens"
) -> DataFrame:
    """``df`` with the number of tokens of each whole text in ``count_col``.

    ``tokenizer`` is the path of a byte-level BPE file on the driver. The numbers are those
    of the tokenizers library without added special tokens, truncation or padding; a
    special token's string in a text counts as that one token. Null and empty texts have
    0, repeated rows stay apart, an empty table gives an empty result, and a column already
    called ``count_col`` is replaced. No row is shuffled.
    """
    return df.withColumn(count_col, count_column(named(text_col), read_vocabulary(tokenizer)))

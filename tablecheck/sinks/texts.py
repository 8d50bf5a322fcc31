"""Sinks for tokenised texts and their dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_texts(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Tokenised texts: plain text files for a lone string column, else Parquet."""
    if [f.dataType.simpleString() for f in df.schema] == ["string"]:
        df.write.mode(mode).text(path)
    else:
        df.write.mode(mode).parquet(path)


def write_dictionary(dictionary: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """``(term, token)`` rows as JSON lines."""
    dictionary.select("term", "token").write.mode(mode).json(path)

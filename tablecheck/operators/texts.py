"""Tokenising text columns and restoring them."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.functions.columns import column
from tablecheck.functions.tokens import (
    TokenStyle,
    found_terms,
    restore_with_buckets,
    restore_with_list,
    token_of,
    token_words,
    tokenize,
)

# A dictionary up to this measured size, counting so much per row besides its texts,
# travels to the texts as a constant of the plan.
LOOKUP_BYTES = 2 * 1024 * 1024
ROW_BYTES = 8
# Restoring by join: a token is hot if it would fill a shuffle partition, or holds a 500th of
# all words. At most 1/share tokens are, which bounds what is kept for them.
MOST_HOT, LEAST_HOT = 20_000, 500
# Working columns beside those of the caller.
ROW, FOUND, ORIGINAL = "_restore_row", "_restore_names", "_restore_original"
NOT_UNIQUE = "restore_text: different texts of one id have the same hash"


def tokenize_text(df: DataFrame, text_col: str, style: TokenStyle = TokenStyle()) -> DataFrame:
    """Replace the text column by its tokenised form: a projection, no shuffle."""
    return df.withColumn(text_col, tokenize(column(text_col), style))


def term_dictionary(df: DataFrame, text_col: str, style: TokenStyle = TokenStyle()) -> DataFrame:
    """``(term, token)`` for every name that ``tokenize_text`` replaces.

    Terms are made distinct per text and per task before the shuffle; tokens are computed
    after it, once per term.
    """
    terms = df.select(F.explode(found_terms(column(text_col), style)).alias("term")).distinct()
    return terms.select("term", token_of(F.col("term"), style).alias("token"))


def term_presence(df: DataFrame, text_col: str, terms: Sequence[str]) -> DataFrame:
    """``(term, texts)``: in how many texts each listed term occurs, from one pass."""
    listed = list(dict.fromkeys(terms))
    # One constant of the plan, parsed while planning, however many terms there are.
    table = F.from_json(F.lit(json.dumps(listed)), "array<string>")
    held = F.filter(table, lambda term: column(text_col).contains(term))
    counts = df.select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("texts"))
    every = df.sparkSession.range(1).select(F.explode(table).alias("term"))
    return every.join(counts, "term", "left").select(
        "term", F.coalesce("texts", F.lit(0).cast("bigint")).alias("texts")
    )


def token_collisions(dictionary: DataFrame) -> DataFrame:
    """``(token, terms, first_term, last_term)`` of tokens that stand for several terms."""
    return (
        dictionary.select("term", "token").distinct().groupBy("token")
        .agg(
            F.count("*").alias("terms"), F.min("term").alias("first_term"),
            F.max("term").alias("last_term"),
        )
        .filter("terms > 1")
    )


def restore_text(
    df: DataFrame, text_col: str, dictionary: DataFrame, id_cols: Sequence[str],
    style: TokenStyle = TokenStyle(), strategy: str = "auto",
) -> DataFrame:
    """``df`` with the known tokens of its text column replaced by their terms.

    A dictionary of at most LOOKUP_BYTES travels to the texts as a constant, and no text is
    shuffled. A larger one, or any with strategy ``"join"``, is joined to the words of the
    texts, which meet their texts again by ``id_cols`` and a hash of the text. The result is
    the same; ``id_cols`` may repeat.
    A token that stands for several terms gives the first of them in text order.
    """
    if strategy not in ("auto", "lookup", "join"):
        raise ValueError("strategy must be 'auto', 'lookup' or 'join'")
    # Nothing else can be met by a word of a text.
    is_token = F.col("token").rlike(f"^[a-fA-F0-9]{{{style.width}}}$")
    names = dictionary.filter(is_token).groupBy("token").agg(F.min("term").alias("term"))
    if strategy == "join":
        return _restore_by_join(df, text_col, names, id_cols, style)
    length = F.octet_length("term") + F.octet_length("token") + F.lit(ROW_BYTES)
    size = names.agg(F.count("*").alias("terms"), F.sum(length).alias("bytes")).first()
    if (size["bytes"] or 0) <= LOOKUP_BYTES:
        return _restore_by_lookup(df, text_col, names, size["terms"], style)
    return _restore_by_join(df, text_col, names, id_cols, style)


def _restore_by_lookup(df, text_col, names, terms, style) -> DataFrame:
    digits = next(n for n in (1, 2, 3, 4) if n in (4, style.width) or 16**n >= terms)
    # At most LOOKUP_BYTES come to the driver, as measured by the caller.
    buckets: list[dict[str, str]] = [{} for _ in range(16**digits)]
    for row in names.collect():
        buckets[int(row["token"][:digits], 16)][row["token"]] = row["term"]
    # JSON makes the table one constant of the plan: it is parsed while planning.
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")
    restored = restore_with_buckets(column(text_col), table, digits, style)
    return df.withColumn(text_col, restored)


def _hot_words(words: DataFrame) -> tuple[list[str], int]:
    """Tokens that hold a large share of all words, and over how many tasks to deal each.

    They are found by a sketch that tasks merge. It only decides which words are salted; the
    result is the same without it.
    """
    partitions = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hottest = min(MOST_HOT, max(LEAST_HOT, partitions))
    row = words.agg(
        F.expr(f"approx_top_k(word, {hottest}, {4 * hottest})").alias("top"),
        F.count("word").alias("n"),
    ).first()
    top = {r["item"]: r["count"] / row["n"] for r in row["top"] or []}
    hot = {word: share for word, share in top.items() if share > 1 / hottest}
    # As many salts as shuffle partitions the hottest word would fill.
    return list(hot), max(2, math.ceil(max(hot.values(), default=0) * partitions))


def _restore_by_join(df, text_col, names, id_cols, style) -> DataFrame:
    # As a struct, ids are equal also where they are null.
    text = column(text_col)
    row = F.struct(*[column(c) for c in id_cols], F.xxhash64(text), F.length(text))
    words = df.select(row.alias(ROW), F.posexplode(token_words(text, style)).alias("pos", "word"))
    # A hot word is dealt over the salts, and its dictionary row repeated for each.
    hot, salts = _hot_words(words)
    dealt = F.pmod(F.xxhash64(ROW, "pos"), F.lit(salts)).cast("int")
    salted = words.withColumn("salt", F.when(F.col("word").isin(hot), dealt).otherwise(0))
    repeats = F.when(F.col("token").isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    by_salt = names.select("token", "term", F.explode(repeats).alias("token_salt"))
    met = (F.col("word") == F.col("token")) & (F.col("salt") == F.col("token_salt"))
    # One group is the words of one text, which one task held before. The texts themselves
    # move once, to meet their words.
    found = F.struct("pos", F.coalesce("term", "word").alias("name"))
    lists = salted.join(by_salt, met, "left").groupBy(ROW).agg(
        # A set, as rows with the same ids and text give the same words.
        F.sort_array(F.collect_set(found))["name"].alias(FOUND)
    )
    error = F.raise_error(F.lit(NOT_UNIQUE)).cast("string")
    restored = restore_with_list(text, F.col(FOUND), style, error)
    return df.join(lists, row == F.col(ROW), "left").select(
        *[restored.alias(c) if c == text_col else column(c) for c in df.columns]
    )


def round_trip_failures(
    df: DataFrame, text_col: str, id_cols: Sequence[str], dictionary: DataFrame | None = None,
    style: TokenStyle = TokenStyle(), strategy: str = "auto",
) -> DataFrame:
    """Texts that do not come back the same: ``(ids, original, restored)``."""
    if dictionary is None:
        dictionary = term_dictionary(df, text_col, style)
    kept = [column(c) for c in id_cols if c != text_col]
    original = df.select(*kept, column(text_col), column(text_col).alias(ORIGINAL))
    tokenized = tokenize_text(original, text_col, style)
    both = restore_text(tokenized, text_col, dictionary, id_cols, style, strategy)
    return both.filter(~column(ORIGINAL).eqNullSafe(column(text_col))).select(
        *[column(c) for c in id_cols], column(ORIGINAL).alias("original"),
        column(text_col).alias("restored"),
    )

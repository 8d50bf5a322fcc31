"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney bigram models are learned, one from toxic and one from ordinary
texts. Both back off to the same distribution, the word counts of the whole corpus, so
an expression that neither class has shown often says nothing about the class. The score
compares the length-normalised log-likelihoods.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.llm.helpers import named
from tablecheck.session import pin

#: Labelled texts that a class is learned from, at most: those with the least hashes.
TEXTS_PER_CLASS = 10_000
#: Expressions with fewer occurrences in the labelled texts are left to the shared counts.
MIN_COUNT = 5
#: Words, and pairs of words, of the model: the most frequent ones of the labelled texts.
MAX_WORDS, MAX_PAIRS = 200_000, 500_000
#: Expressions that a task counts before it hands them on, to be summed by all tasks.
HELD = 150_000
DISCOUNT = 0.75
#: Where the classes differ by less than this factor, both take the shared probability: the
#: classes' mixtures of languages and subjects differ by chance.
LEAST_FACTOR = 10.0
#: Added to the length, so that short texts need more evidence a word.
LENGTH_PRIOR = 30
#: Expressions: up to four characters of a word, with the blank before it; inflected and compound
#: forms of a rare word share them, and pairs join them again.
WORD = r" ?\w{1,4}"
BEGIN = ""
CLASSES = ("toxic", "ordinary")
#: A false alarm weighs as much as so many misses.
FALSE_ALARM_COST = 5.0


@dataclass
class Model:
    """What scoring needs; its size is bounded by MAX_WORDS and MAX_PAIRS."""

    words: dict[str, int]
    word_ratio: np.ndarray  # log-likelihood ratio of each word after an unknown context
    rest_ratio: np.ndarray  # log ratio of the backoff weights of each word as a context
    unknown: float  # log-likelihood ratio of a word that is not in the model
    pairs: np.ndarray  # sorted, context * number of words + word
    pair_ratio: np.ndarray  # log-likelihood ratio of each of them
    slope: float = 1.0
    middle: float = 0.0

    def compare(self, text: str | None) -> float:
        """Toxic minus ordinary log-likelihood of a text by its length."""
        known = self.words
        ids = np.array([known.get(w, -1) for w in words_of(text)], np.int64)
        if not len(ids):
            return 0.0
        before = np.append(-1, ids[:-1])
        ratio = np.where(ids >= 0, self.word_ratio[ids], self.unknown)
        ratio = ratio + np.where(before >= 0, self.rest_ratio[before], 0.0)
        if len(self.pairs):
            key = before * len(known) + ids
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = (self.pairs[at] == key) & (before >= 0) & (ids >= 0)
            ratio = np.where(hit, self.pair_ratio[at], ratio)
        ratio = np.where(np.abs(ratio) < math.log(LEAST_FACTOR), 0.0, ratio)
        return float(ratio.sum() / (len(ids) + LENGTH_PRIOR))

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.slope * (self.compare(text) - self.middle)))))


def words_of(text: str | None) -> list[str]:
    return re.findall(WORD, (text or "").lower())


def labelled_sample(labels: DataFrame, texts_per_class: int) -> DataFrame:
    """(id, toxic, tune): equally many rows of both classes, those with the least hashes.

    There are as many as the rarer class has, up to ``texts_per_class``: discounts weigh
    on small counts, so classes of different sizes would differ where their texts do not. A
    fifth of the rows, by another hash, tunes the threshold and is not counted.
    """
    hashed = (
        labels.where("id is not null and toxic in (0, 1)").distinct()
        .withColumn("h", F.xxhash64("id", F.lit("sample")))
    )
    sizes = {r["toxic"]: r["n"] for r in hashed.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = min(texts_per_class, *(sizes.get(c, 0) for c in (0, 1)))
    parts = [hashed.where(F.col("toxic") == c).orderBy("h", "id").limit(n) for c in (0, 1)]
    tune = F.pmod(F.xxhash64("id", F.lit("tune")), F.lit(5)) == 0
    return parts[0].union(parts[1]).select("id", F.col("toxic").cast("int").alias("toxic"), tune.alias("tune"))


def corpus_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts of the corpus, counted by batch before the shuffle."""

    def rows_of(found: Counter) -> pa.RecordBatch:
        columns = [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            for text in batch["text"]:
                found.update(words_of(text.as_py()))
                if len(found) > HELD:
                    yield rows_of(found)
                    found = Counter()
        yield rows_of(found)

    rows = df.select(named(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(texts: DataFrame) -> DataFrame:
    """(context, word, toxic, ordinary): pairs of words in the labelled texts (toxic, text)."""

    def rows_of(found: Counter) -> pa.RecordBatch:
        context, word, toxic = zip(*found) if found else ((), (), ())
        columns = [pa.array(context, pa.string()), pa.array(word, pa.string()),
                   pa.array(toxic, pa.int32()), pa.array(list(found.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["context", "word", "toxic", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            for toxic, text in zip(batch["toxic"].to_pylist(), batch["text"]):
                words = words_of(text.as_py())
                found.update(zip([BEGIN, *words], words, [toxic] * len(words)))
                if len(found) > HELD:
                    yield rows_of(found)
                    found = Counter()
        yield rows_of(found)

    rows = texts.select("toxic", "text").mapInArrow(
        count, "context string, word string, toxic int, n long"
    )
    return rows.groupBy("context", "word").agg(
        *[F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(name)
          for c, name in ((1, "toxic"), (0, "ordinary"))]
    )


def learn(
    df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    texts_per_class: int = TEXTS_PER_CLASS,
) -> Model | None:
    """Count, smooth and tune; None if a class has no text to learn from.

    ``labels`` has (id, toxic). The driver gets the words and pairs of the model, bounded by
    MAX_WORDS and MAX_PAIRS, and sums over all others.
    """
    # As many rows as the parameter allows, so the texts of the corpus need not move.
    sample = F.broadcast(labelled_sample(labels, texts_per_class).withColumnRenamed("id", "_id"))
    texts = pin(
        df.select(named(id_col).alias("_id"), named(text_col).alias("text")).join(sample, "_id")
        .select("toxic", "tune", "text"), "labelled",
    )
    pairs = pin(pair_counts(texts.where("not tune")), "pairs")
    count = F.col("toxic") + F.col("ordinary")

    def kinds(c: str, name: str) -> Column:
        return F.sum((F.col(c) > 0).cast("long")).alias(name)

    # As a word: in how many contexts it stands. As a context: what follows it.
    as_word = pairs.groupBy("word").agg(
        F.sum(count).alias("n"), *[kinds(c, f"{c}_stands") for c in CLASSES]
    )
    as_context = pairs.groupBy(F.col("context").alias("word")).agg(
        *[F.sum(c).alias(f"{c}_after") for c in CLASSES], *[kinds(c, f"{c}_follow") for c in CLASSES]
    )
    sums = as_word.agg(
        *[F.coalesce(F.sum(f"{c}_stands"), F.lit(0)).alias(c) for c in CLASSES],
        *[kinds(f"{c}_stands", f"{c}_words") for c in CLASSES],
    ).first().asDict()
    if not sums["toxic"] or not sums["ordinary"]:
        return None
    frequent = pin(as_word.where(F.col("n") >= MIN_COUNT).orderBy(F.desc("n"), "word").limit(MAX_WORDS), "words")
    # One row for each word of the model and one for all others.
    spoken = corpus_counts(df, text_col).join(frequent.select("word", F.lit(1).alias("kept")), "word", "left")
    spoken = pin(
        spoken.groupBy(F.when(F.col("kept") == 1, F.col("word")).alias("word")).agg(F.sum("n").alias("shared")), "spoken"
    )
    table = frequent.join(spoken, "word", "left").join(as_context, "word", "left").orderBy("word").toPandas()
    top = pairs.where(count >= MIN_COUNT).orderBy(count.desc(), "context", "word").limit(MAX_PAIRS)
    model = smooth(table.fillna(0), top.toPandas(), sums, spoken.agg(F.sum("shared")).first()[0])
    compared = F.arrow_udf(
        lambda batch: pa.array([model.compare(t.as_py()) for t in batch], pa.float64()), T.DoubleType()
    )
    # No more rows than texts_per_class allows.
    tuned = texts.where("tune").select("toxic", compared("text").alias("x")).toPandas()
    model.middle, model.slope = threshold(tuned["x"].to_numpy(), tuned["toxic"].to_numpy())
    return model


def smooth(table, top, sums: dict[str, int], spoken: int) -> Model:
    """Interpolated Kneser-Ney with one discount; the lowest order backs off to the corpus."""
    words = {w: i for i, w in enumerate(table["word"])}
    shared = (table["shared"].to_numpy(float) + 1) / (spoken + len(words) + 1)
    word, rest, base = {}, {}, {}
    for c in CLASSES:
        base[c] = DISCOUNT * sums[f"{c}_words"] / sums[c]
        stands = np.maximum(table[f"{c}_stands"].to_numpy(float) - DISCOUNT, 0)
        word[c] = stands / sums[c] + base[c] * shared
        after, follow = table[f"{c}_after"].to_numpy(float), table[f"{c}_follow"].to_numpy(float)
        rest[c] = np.where(after > 0, DISCOUNT * follow / np.maximum(after, 1), 1.0)
    context = np.array([words.get(w, -1) for w in top["context"]], np.int64)
    follows = np.array([words.get(w, -1) for w in top["word"]], np.int64)
    both = (context >= 0) & (follows >= 0)
    context, follows = context[both], follows[both]
    pair = {}
    for c in CLASSES:
        after = np.maximum(table[f"{c}_after"].to_numpy(float)[context], 1)
        pair[c] = np.maximum(top[c].to_numpy(float)[both] - DISCOUNT, 0) / after + rest[c][context] * word[c][follows]
    keys = context * len(words) + follows
    order = np.argsort(keys)
    ratio = lambda p: np.log(p["toxic"]) - np.log(p["ordinary"])
    # One entry at least, so that index -1 is defined where no word is known.
    pad = lambda x: x if len(x) else np.zeros(1)
    return Model(words, pad(ratio(word)), pad(ratio(rest)), float(ratio(base)), keys[order], ratio(pair)[order])


def threshold(x: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """(middle, slope): the cut with the least cost of errors, a false alarm costing more."""
    yes, no = np.sort(x[toxic == 1]), np.sort(x[toxic == 0])
    if not len(yes) or not len(no):
        return 0.0, 1.0
    values = np.unique(x)
    cuts = np.append((values[1:] + values[:-1]) / 2, values[-1] + 1e-6)
    missed = np.searchsorted(yes, cuts) / len(yes)
    alarms = 1 - np.searchsorted(no, cuts) / len(no)
    cost = missed + FALSE_ALARM_COST * alarms
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float(cuts[best].mean()), float(4 / max(np.std(no), 1e-3))


def score_column(text: Column, model: Model | None) -> Column:
    """0 to 1, higher for likelier toxic; 0 everywhere without a model."""
    if model is None:
        return F.lit(0.0)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([model.score(t.as_py()) for t in batch], pa.float64())

    return F.arrow_udf(score, T.DoubleType())(text)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves no remainder by 5; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_toxicity(
    df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", score_col: str = "score", texts_per_class: int = TEXTS_PER_CLASS,
) -> DataFrame:
    """``df`` with ``score_col``: how likely the whole text is toxic, from 0 to 1.

    Learns from the rows of ``df`` that ``labels`` marks 0 or 1 and that are not held out, at
    most ``texts_per_class`` of each class; only texts enter a score. The shared backoff counts are
    those of all rows of ``df``. Null and empty texts score like a text without evidence. If
    an id is labelled both ways both labels count; labels and rows without an id are not
    learned from. Without texts of both classes every score is 0. Repeated rows are scored each,
    an empty table gives an empty result, an existing ``score_col`` is replaced.
    """
    known = labels.select(named(id_col).alias("id"), named(label_col).alias("toxic"))
    model = learn(
        df, known.where(~held_out(F.col("id"))), id_col=id_col, text_col=text_col, texts_per_class=texts_per_class
    )
    return df.withColumn(score_col, score_column(named(text_col), model))

"""Substring dedup: sentence spans that occur before are removed from later documents.

Every run of consecutive sentences that is long enough is hashed. A run is the shortest
one of at least ``min_sentences`` sentences and ``min_words`` words that begins, or that
ends, at a sentence, so a passage is covered up to its first and last sentence. Runs are
joined globally on their hash; a run that has an earlier occurrence is not the first, and
the sentences it covers are cut.

Passages of over 50 words are found wherever sentences end too: sentences of more than REACH words are
cut into pieces at places that nearby words choose, and runs of such pieces, and of sentences
beside them, of at least PIECE_WORDS words are hashed as well.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.llm.helpers import fresh, named, row_key
from tablecheck.session import pin

MIN_SENTENCES, MIN_WORDS = 2, 12
#: A sentence ends at white space after . ! or ?, and at each line end.
BOUNDARY = r"(?:(?<=[.!?])[^\S\n]|\n)\s*"
LATER, START_BITS = 1 << 62, 31
#: Of so many neighbouring places between words one at least ends a piece, and a run with pieces has
#: so many words. A passage of REACH * 2 + PIECE_WORDS words or more holds such a run.
REACH, PIECE_WORDS = 13, 24
WORD = re.compile(r"\S+")


def sentences(text: str, boundary) -> list[tuple[int, int]]:
    """(start, end) of each sentence, with the white space behind it."""
    cuts = [0, *(m.end() for m in boundary.finditer(text))]
    if cuts[-1] != len(text):
        cuts.append(len(text))
    return list(zip(cuts, cuts[1:]))


def piece_ends(words: list[str], reach: int = REACH) -> list[int]:
    """Where the pieces of a long sentence end, as numbers of words.

    Places are known by the hash of the words on both sides; each window of ``reach`` places
    chooses its least one, so equal passages are cut alike but for their first and last words.
    Among equal ones a place that is chosen already stays, so one word over and over is cut
    every ``reach`` words.
    """
    raw = [w.encode() for w in words]
    pairs = [zlib.crc32(b, zlib.crc32(a)) for a, b in zip(raw, raw[1:])]
    out, at = [], -1
    for end in range(reach - 1, len(pairs)):
        begin = end - reach + 1
        if at < begin:
            least = min(pairs[begin : end + 1])
            at = next(k for k in range(end, begin - 1, -1) if pairs[k] == least)
        elif pairs[end] < pairs[at]:
            at = end
        else:
            continue
        out.append(at + 1)
    return [*out, len(words)]


def _digest(words: list[str]) -> bytes:
    return xxhash.xxh64_digest(" ".join(words).encode())


def _forward(total: np.ndarray, least: int, words: int) -> np.ndarray:
    """Where the shortest run from each unit on ends that has ``least`` units and ``words`` words."""
    return np.maximum(np.arange(len(total)) + least, np.searchsorted(total, total + words))


def _back(total: np.ndarray, least: int, words: int) -> np.ndarray:
    """Where the shortest such run up to each unit begins."""
    return np.minimum(np.arange(len(total)) - least, np.searchsorted(total, total - words, "right") - 1)


def runs(text: str, boundary, min_sentences: int, min_words: int) -> list[tuple[int, int]]:
    """(hash, packed span) of the runs of a text.

    A span is start * 2^31 + end in characters; LATER is added where the text itself has
    an earlier run of that hash. Case and the kind of white space do not count.
    Besides the runs of sentences there are those of units: sentences of up to REACH words, and the pieces of longer
    ones. From each unit on, and up to the end of each cut sentence, there is the shortest one of at least
    two units and PIECE_WORDS words, if it has a piece in it. A run of one unit over and over is no
    repeat of what stands before it in the text, but it is one of an earlier text.
    """
    kept, sizes, digests = [], [], []
    units, lengths, codes, pieces, closed = [], [], [], [], []
    for a, b in sentences(text, boundary):
        words = text[a:b].lower().split()
        if not words:
            continue
        kept.append((a, b))
        sizes.append(len(words))
        digests.append(_digest(words))
        if len(words) <= REACH:
            units.append((a, b))
            lengths.append(len(words))
            codes.append(digests[-1])
            pieces.append(0)
            continue
        starts = [m.start() for m in WORD.finditer(text, a, b)]
        begin = 0
        for end in piece_ends(words):
            units.append((starts[begin] if begin else a, starts[end] if end < len(words) else b))
            lengths.append(end - begin)
            codes.append(_digest(words[begin:end]))
            pieces.append(1)
            begin = end
        closed.append(len(units))
    n = len(kept)
    found = {}
    if n >= min_sentences:
        total = np.append(0, np.cumsum(sizes))
        ahead, back = _forward(total, min_sentences, min_words), _back(total, min_sentences, min_words)
        spans = {(i, j) for i, j in enumerate(ahead.tolist()) if j <= n}
        spans |= {(i, j) for j, i in enumerate(back.tolist()) if i >= 0}
        joined = b"".join(digests)
        found = {(kept[i][0], kept[j - 1][1], joined[8 * i : 8 * j]): False for i, j in spans}
    if closed:
        total, held = np.append(0, np.cumsum(lengths)), np.append(0, np.cumsum(pieces))
        ahead = _forward(total, 2, PIECE_WORDS)
        some = np.flatnonzero(ahead <= len(units))
        some = some[held[ahead[some]] > held[some]]
        spans = set(zip(some.tolist(), ahead[some].tolist()))
        back = _back(total, 2, PIECE_WORDS)[closed]
        spans |= {(i, j) for i, j in zip(back.tolist(), closed) if i >= 0}
        joined = b"".join(codes)
        for i, j in spans:
            key = joined[8 * i : 8 * j]
            found[units[i][0], units[j - 1][1], key] = key == codes[i] * (j - i)
    seen, out = set(), []
    for (start, end, key), dull in sorted(found.items()):
        code = xxhash.xxh64_intdigest(key)
        code -= (code >> 63) << 64
        span = (start << START_BITS) + end
        out.append((code, span + (LATER if code in seen and not dull else 0)))
        seen.add(code)
    return out


def cut(text: str, spans: list[int]) -> str:
    """``text`` without the packed spans, which may overlap and come in any order."""
    mask, out, at = (1 << START_BITS) - 1, [], 0
    for span in sorted(s & (LATER - 1) for s in spans):
        start, end = span >> START_BITS, span & mask
        if start > at:
            out.append(text[at:start])
        at = max(at, end)
    return "".join([*out, text[at:]])


def cut_column(text: Column, spans: Column) -> Column:
    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            yield pa.array(
                [t.as_py() if not s.is_valid else cut(t.as_py(), s.as_py()) for t, s in zip(texts, lists)],
                pa.string(),
            )

    return F.arrow_udf(apply, T.StringType())(text, spans)


def span_table(
    df: DataFrame, min_sentences: int, min_words: int, id_col: str, text_col: str
) -> DataFrame:
    """(hash, id, row, span) of every run of every text; see ``runs``."""
    rows = df.select(
        named(id_col).alias("id"), row_key(named(id_col), named(text_col)).alias("row"),
        named(text_col).alias("text"),
    )

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boundary = re.compile(BOUNDARY)
        for batch in batches:
            owner, codes, packed = [], [], []

            def flush():
                at = pa.array(owner, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [pa.array(codes, pa.int64()), batch["id"].take(at), batch["row"].take(at),
                     pa.array(packed, pa.int64())], names=["hash", "id", "row", "span"],
                )

            for i, text in enumerate(batch["text"]):
                for code, span in runs(text.as_py() or "", boundary, min_sentences, min_words):
                    owner.append(i)
                    codes.append(code)
                    packed.append(span)
                if len(owner) > 200_000:
                    yield flush()
                    owner, codes, packed = [], [], []
            yield flush()

    schema = (
        T.StructType().add("hash", "long").add("id", rows.schema["id"].dataType)
        .add("row", "long").add("span", "long")
    )
    return rows.mapInArrow(spans, schema)


def remove_repeats(
    df: DataFrame, *, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS,
    id_col: str = "doc_id", text_col: str = "text", cut_col: str | None = None,
) -> DataFrame:
    """``df`` with repeated sentence spans cut out of ``text_col``.

    The first occurrence of a span is the one in the least id, there the leftmost. Later ones
    lose the sentences, or pieces of a long sentence, that they cover, with the white space
    behind them; a text may become empty, its row stays. A repeated passage of over 50 varied
    words is found wherever sentences end, but some words at its ends may stay. Rows of one id
    count as one document, so they do not lose what they share, and null ids count as one document
    behind all others. Null texts stay null; texts
    with fewer than ``min_words`` words have no span. Texts
    may have 2^31 - 1 characters. With ``cut_col`` a column of that name (an existing one is
    replaced) holds the characters cut from each text.

    Runs of different sentences meet only if 64-bit hashes collide.
    """
    # Texts are cut into runs once; both reads below take them from there.
    table = pin(span_table(df, min_sentences, min_words, id_col, text_col), "runs")
    # Counted before the shuffle, so a passage of very many documents is a few rows.
    firsts = table.groupBy("hash").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    # Written, so that the join below reads plain shuffles, whose hot hashes Spark can split.
    repeated = pin(firsts.where("n > 1").drop("n"), "repeated")
    later = (
        (F.col("span") >= LATER) | (F.col("id") > F.col("first"))
        | (F.col("id").isNull() & F.col("first").isNotNull())
    )
    found = table.join(repeated, "hash").where(later)
    own_id, own_row, spans = fresh(df, "own_id", "own_row", "own_spans")
    per_text = found.groupBy(F.col("id").alias(own_id), F.col("row").alias(own_row)).agg(
        F.collect_set("span").alias(spans)
    )
    key = row_key(named(id_col), named(text_col)) == F.col(own_row)
    joined = df.join(per_text, key & named(id_col).eqNullSafe(F.col(own_id)), "left")
    out = joined.withColumn(own_id, cut_column(named(text_col), F.col(spans)))
    columns = [
        F.col(own_id).alias(c) if c.lower() == text_col.lower() else named(c)
        for c in df.columns if cut_col is None or c.lower() != cut_col.lower()
    ]
    if cut_col is not None:
        lost = F.coalesce(F.length(named(text_col)) - F.length(own_id), F.lit(0)).cast("long")
        columns.append(lost.alias(cut_col))
    return out.select(*columns)

"""Token ids as ORC files.

One row is one document: its id, the file part it is in, the ids before it in that part, how
many it has, and these. Rows lie in ascending order of document ids, across files too. ORC stores the
integer columns by run-length encoding, keeps minima and maxima per stripe and row group
(row indexes) and Bloom filters of the document ids, so that a reader splits files by
stripes and skips those without the documents it wants.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.llm.bpe import blocks, byte_symbols, read_vocabulary
from tablecheck.llm.helpers import named

STRIPE_BYTES = 64 * 1024 * 1024
ROW_GROUP = 10_000
#: Stored bytes of a document besides those of its text, for sizing the parts.
PART_ROWS = 200_000
#: Text that is encoded together, in characters; at least one whole text.
BLOCK_CHARS = 2_000_000
#: Words whose ids a task remembers.
REMEMBERED = 400_000
#: Marks that the split takes for words of their own behind letters. An apostrophe may belong
#: to letters behind it.
STOPS = ".,;:!?*#$%&|<>()[]{}/+=~^@_\"-"
#: Characters below it are in composed form and none of them is a mark.
COMPOSED = "\u0300"


def encode_words(source: str):
    """A function from a list of texts to the ids of each text, as numpy arrays.

    Words between blanks and line ends are encoded once and remembered. This is exact where
    the tokenizer drops white space and no rule of it looks across white space, as with
    Unicode normalization, lower-casing and a split that removes what is no word. A word of
    nothing but letters goes straight to the library's model, any other through all its rules.
    """
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    spec = json.loads(source)
    rules = spec["normalizer"]["normalizers"] if spec["normalizer"] else []
    splits = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    apart = (
        {r["type"] for r in rules} <= {"NFC", "Replace", "Lowercase"}
        and splits[0].get("behavior") == "Removed" and splits[0].get("invert")
        and not any(" " in t["content"] or "\n" in t["content"] or t["lstrip"] or t["rstrip"]
                    or t["single_word"] for t in spec["added_tokens"])
    )
    tokenizer = Tokenizer.from_str(source)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if not apart:
        return lambda texts: [
            np.array(e.ids, "<u4")
            for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]
    model, symbols = tokenizer.model, byte_symbols()
    added = "".join(t["content"] for t in spec["added_tokens"])
    marks = "".join(c for c in STOPS if c not in added)

    def plain_word(word: str) -> bytes:
        """Ids of lower-case letters, which all rules leave as they are."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(symbols)
        return array("I", [t.id for t in model.tokenize(word)]).tobytes()

    def whole(word: str) -> bytes:
        return array("I", tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def word_ids(word: str) -> bytes:
        # Letters, and full stops and the like behind them, are split from each other.
        letters = word.rstrip(marks)
        low = letters.lower()
        if not letters.isalpha() or not (low.isascii() or max(letters + low) < COMPOSED):
            return whole(word)
        if low not in known:
            known[low] = plain_word(low)
        if letters == word:
            return known[low]
        stops = word[len(letters) :]
        if stops not in known:
            known[stops] = whole(stops)
        return known[low] + known[stops]

    class Known(dict):
        def __missing__(self, word: str) -> bytes:
            ids = self[word] = word_ids(word)
            return ids

    known = Known()

    def encode(texts: list[str]) -> list[np.ndarray]:
        if len(known) > REMEMBERED:
            known.clear()
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        return [np.frombuffer(b"".join(map(known.__getitem__, p)), "<u4") for p in parts]

    return encode


def encode_rows(texts: list[str], encoder, end_id: int | None) -> pa.ListArray:
    """The ids of each text, with ``end_id`` behind them."""
    end = np.array([] if end_id is None else [end_id], "<u4")
    rows = [x for row in encoder(texts) for x in (row, end)]
    lengths = np.array([len(r) for r in rows], np.int64).reshape(-1, 2).sum(axis=1)
    ends = np.append(0, np.cumsum(lengths)).astype(np.int32)
    flat = np.concatenate(rows).astype(np.int32) if rows else np.array([], np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def write_token_orc(
    df: DataFrame, path: str, tokenizer: str, *, end_id: int | None = None,
    id_col: str = "doc_id", text_col: str = "text", parts: int | None = None,
) -> None:
    """Encode the whole texts of ``df`` and write their ids to ORC files in ``path``.

    ``tokenizer`` is the path of a tokenizers file on the driver. Documents are dealt to
    ``parts`` files by ranges of ``id_col``, a part for every 200,000 rows if not given and
    no fewer than there are shuffle partitions. Null ids come first; rows of one id are
    ordered by their texts, and rows equal in both are interchangeable. Null texts are
    empty. Other columns are not written. An empty table gives a readable empty folder.
    """
    docs = df.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    if parts is None:
        rows = -(-docs.count() // PART_ROWS)
        parts = max(rows, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.xxhash64("text")  # in the range, so that many rows of one id fill several parts
    dealt = docs.repartitionByRange(parts, "doc_id", key).sortWithinPartitions("doc_id", key, "text")
    source = read_vocabulary(tokenizer)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, encoder = TaskContext.get().partitionId(), 0, encode_words(source)
        for batch in batches:
            done = 0
            for texts in blocks((t.as_py() for t in batch["text"]), BLOCK_CHARS):
                ids = encode_rows(texts, encoder, end_id)
                lengths = np.diff(ids.offsets.to_numpy())
                starts = before + np.cumsum(lengths, dtype=np.int64) - lengths
                before += int(lengths.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(done, len(texts)), pa.array(np.full(len(texts), part, np.int32)),
                     pa.array(starts), pa.array(lengths.astype(np.int32)), ids],
                    names=["doc_id", "part", "before", "n", "ids"],
                )
                done += len(texts)

    kind = docs.schema["doc_id"].dataType
    schema = (
        T.StructType().add("doc_id", kind).add("part", "integer").add("before", "long")
        .add("n", "integer").add("ids", T.ArrayType(T.IntegerType()))
    )
    (
        dealt.mapInArrow(place, schema).write.mode("errorifexists")
        .option("orc.stripe.size", STRIPE_BYTES).option("orc.create.index", "true")
        .option("orc.row.index.stride", ROW_GROUP).option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01").option("compression", "zstd").orc(path)
    )


def read_token_orc(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """The documents of ``write_token_orc``: doc_id, part, before, n, ids.

    With ``doc_ids`` only those; the filter reaches the scan, which skips stripes and row
    groups by minima, maxima and Bloom filters.
    """
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def with_starts(rows: DataFrame) -> DataFrame:
    """``read_token_orc`` rows with ``start``, the number of ids in all documents before.

    The parts' totals, one row for each file, are summed up in order of the parts and
    broadcast: 12 bytes for the 200,000 documents or more of a file.
    """
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("before")).drop("base")


def crc32_of_ids(ids: Column) -> Column:
    """Unsigned CRC-32 of each array's integers, little-endian with 32 bits each."""

    def crc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat = batch.values.to_numpy(zero_copy_only=False).astype("<u4")
            cuts = batch.offsets.to_numpy()
            yield pa.array(
                [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])], pa.int64()
            )

    return F.arrow_udf(crc, T.LongType())(ids)

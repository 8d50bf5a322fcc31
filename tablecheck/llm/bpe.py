"""Byte-level BPE encoding and decoding by a pair occurrence index.

The distinct pre-tokens of a block of rows lie one after another in one array of symbols.
Every pair with a merge rank is mapped to all its positions in that array. The active ranks
are applied in ascending order, each to all its positions at once; the lists of the pairs
that arise beside them are updated. What the texts share is thus merged once per block.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.llm.helpers import fresh, gather, named, offsets

#: Splits text before the merges; a fixed value of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Text of a block, in characters; a block has at least one whole text.
BLOCK_CHARS = 5_000_000


def read_vocabulary(path: str) -> str:
    """The text of a tokenizer file; its size is that of a vocabulary, whatever the corpus."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Codes(dict):
    """Gives each new word the next number."""

    def __missing__(self, word):
        code = self[word] = len(self)
        return code


@dataclass
class Merges:
    """A vocabulary as arrays: what the merge loop and the decoder look up."""

    base: np.ndarray  # symbol id of each byte
    keys: np.ndarray  # left * width + right of each merge, sorted
    ranks: np.ndarray  # rank of the merge at the same place in keys
    left: np.ndarray  # by rank
    right: np.ndarray
    made: np.ndarray
    width: int
    special: dict[str, int]
    piece_bytes: np.ndarray  # the bytes of all ids, one after another
    piece_starts: np.ndarray
    piece_lengths: np.ndarray


def load_merges(source: str) -> Merges:
    """Read a byte-level BPE file in the JSON form of the tokenizers library.

    Raises ValueError for what this encoder does not do: normalizers, unknown-token
    rules, dropout, special tokens that strip or match single words, and merge lists in
    which a merge makes a symbol that an earlier one used or made.
    """
    spec = json.loads(source)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE" and spec["normalizer"] is None and split.get("type") == "ByteLevel"
        and split["use_regex"] and not split["add_prefix_space"]
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                           "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]
                    for t in spec["added_tokens"])
    )
    if not plain:
        raise ValueError("only plain byte-level BPE files are read here")
    ids = model["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
    left = np.array([ids[a] for a, _ in pairs], np.int64)
    right = np.array([ids[b] for _, b in pairs], np.int64)
    made = np.array([ids[a + b] for a, b in pairs], np.int64)
    width = max([*ids.values(), *special.values()]) + 1
    born = np.full(width, -1, np.int64)
    born[made] = np.arange(len(made))
    if len(set(made.tolist())) != len(made) or np.any(
        np.maximum(born[left], born[right]) >= np.arange(len(made))
    ):
        raise ValueError("a merge makes a symbol that is in use before it")
    keys = left * width + right
    order = np.argsort(keys)
    shown = byte_symbols()
    byte_of = {c: b for b, c in shown.items()}
    pieces = [b""] * width
    for piece, i in [*ids.items(), *special.items()]:
        known = all(c in byte_of for c in piece)
        pieces[i] = bytes(byte_of[c] for c in piece) if known else piece.encode()
    lengths = np.array([len(p) for p in pieces], np.int64)
    return Merges(
        np.array([ids[shown[b]] for b in range(256)], np.int32), keys[order], order, left, right,
        made, width, special, np.frombuffer(b"".join(pieces), np.uint8), offsets(lengths), lengths,
    )


def leftmost(positions: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of a pair of equal symbols, the positions that merge when read from the left."""
    kept, taken = [], -1
    for p, q in zip(positions.tolist(), after.tolist()):
        if p != taken:
            kept.append(p)
            taken = q
    return np.array(kept, np.int32)


def merge_words(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one after another, and how many each word has."""
    sizes = np.array([len(w) for w in words], np.int64)
    symbols = merges.base[np.frombuffer(b"".join(words), np.uint8)]
    n = len(symbols)
    if not n:
        return symbols, sizes
    # A block has fewer than 2^31 bytes, as any text of Spark's has.
    here = np.arange(n, dtype=np.int32)
    after, before = here + np.int32(1), here - np.int32(1)
    starts = offsets(sizes)[sizes > 0]
    before[starts] = -1
    after[np.append(starts[1:], n) - 1] = -1
    positions: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def index(places: np.ndarray) -> None:
        """Enter the pairs that begin at these places into the lists of their ranks."""
        key = symbols[places].astype(np.int64) * merges.width + symbols[after[places]]
        slot = np.minimum(np.searchsorted(merges.keys, key), len(merges.keys) - 1)
        hit = merges.keys[slot] == key
        places, ranks = places[hit], merges.ranks[slot[hit]]
        if not len(places):
            return
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(places, cuts)):
            if rank not in positions:
                positions[rank] = []
                heapq.heappush(active, rank)
            positions[rank].append(part)

    if len(merges.keys):
        index(here[after >= 0])
    while active:
        rank = heapq.heappop(active)
        parts = positions.pop(rank)
        places = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        a, b = merges.left[rank], merges.right[rank]
        follow = after[places]
        # Neighbours may have merged since the place was entered.
        good = (symbols[places] == a) & (follow >= 0)
        good &= symbols[follow] == b
        places = places[good]
        if a == b and len(places):
            places = leftmost(places, after[places])
        if not len(places):
            continue
        gone = after[places]
        beyond = after[gone]
        symbols[places] = merges.made[rank]
        symbols[gone] = -1
        after[places] = beyond
        inner = beyond >= 0
        before[beyond[inner]] = places[inner]
        left = before[places]
        index(np.unique(np.concatenate([left[left >= 0], places[inner]])))
    alive = symbols >= 0
    counts = np.zeros(len(words), np.int64)
    counts[sizes > 0] = np.add.reduceat(alive, starts, dtype=np.int64)
    return symbols[alive], counts


def blocks(texts: Iterator[str | None], limit: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """The texts in blocks of about ``limit`` characters; nulls become empty."""
    block, size = [], 0
    for text in texts:
        block.append(text or "")
        size += len(block[-1])
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def word_splitter(special: dict[str, int]):
    """A function from a text to its pre-tokens; special tokens come out whole."""
    find, beyond = regex.compile(PATTERN).findall, regex.compile("[^\\x00-\u0557]").search

    def words(text: str) -> list[str]:
        # Libraries know letters of different Unicode versions: where a character is too new
        # for this one, the tokenizers library splits the text.
        if beyond(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            from tokenizers.pre_tokenizers import ByteLevel

            found = ByteLevel(add_prefix_space=False).pre_tokenize_str(text)
            return [text[a:b] for _, (a, b) in found]
        return find(text)

    if not special:
        return words
    marks = regex.compile("(" + "|".join(regex.escape(s) for s in special) + ")")

    def split(text: str) -> list[str]:
        if not any(s in text for s in special):
            return words(text)
        out = []
        for i, part in enumerate(marks.split(text)):
            out += [part] if i % 2 else words(part)
        return out

    return split


def encode_block(texts: list[str], merges: Merges) -> Iterator[np.ndarray]:
    """The ids of each text, as little-endian unsigned 32-bit integers."""
    split, codes = word_splitter(merges.special), Codes()
    coded = [np.fromiter(map(codes.__getitem__, split(t)), np.int32) for t in texts]
    marks = [(codes[s], i) for s, i in merges.special.items()]
    special = {code for code, _ in marks}
    flat, lengths = merge_words(
        [b"" if c in special else w.encode() for w, c in codes.items()], merges
    )
    starts = offsets(lengths)
    for code, i in marks:  # their ids stand behind all others
        starts[code], lengths[code] = len(flat), 1
        flat = np.append(flat, i)
    flat = flat.astype("<u4")
    for row in coded:
        yield gather(flat, starts, lengths, row)


def encode_column(text: Column, source: str) -> Column:
    """Token ids of ``text``: a binary of little-endian unsigned 32-bit integers.

    ``source`` is the text of the tokenizer file. Null texts and empty texts have no ids.
    """

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        merges = load_merges(source)
        for batch in batches:
            for block in blocks(v.as_py() for v in batch):
                yield pa.array([row.tobytes() for row in encode_block(block, merges)], pa.binary())

    return F.arrow_udf(encode, T.BinaryType())(text)


def decode_row(ids: bytes, merges: Merges) -> str:
    """The text of one row of ids; an id that the vocabulary does not have has no text."""
    row = np.frombuffer(ids, "<u4").astype(np.int64)
    row = row[row < merges.width]
    raw = gather(merges.piece_bytes, merges.piece_starts, merges.piece_lengths, row).tobytes()
    return raw.decode("utf-8", "replace")


def decode_column(ids: Column, source: str) -> Column:
    """The text of binaries of token ids; bytes that are no UTF-8 become U+FFFD.

    Special tokens are written out. A null has the empty text. An id that the
    vocabulary does not have has no text.
    """

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        merges = load_merges(source)
        for batch in batches:
            texts, size = [], 0
            for value in batch:
                texts.append(decode_row(value.as_py() or b"", merges))
                size += len(texts[-1])
                if size > BLOCK_CHARS:
                    yield pa.array(texts, pa.string())
                    texts, size = [], 0
            if texts:
                yield pa.array(texts, pa.string())

    return F.arrow_udf(decode, T.StringType())(ids)


def round_trip_column(text: Column, source: str) -> Column:
    """Struct of ``token_ids`` and the text ``decoded`` from them, by one task for each row.

    The same as ``decode_column`` of ``encode_column``, without a second Python process beside the
    first and without the ids going to and fro between them.
    """
    kind = T.StructType().add("token_ids", T.BinaryType()).add("decoded", T.StringType())

    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        merges = load_merges(source)
        for batch in batches:
            for block in blocks(v.as_py() for v in batch):
                ids = [row.tobytes() for row in encode_block(block, merges)]
                del block
                texts = pa.array([decode_row(row, merges) for row in ids], pa.string())
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), texts], ["token_ids", "decoded"])

    return F.arrow_udf(both, kind)(text)


def encode(
    df: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "token_ids"
) -> DataFrame:
    """``df`` with the token ids of ``text_col`` in ``ids_col``.

    ``tokenizer`` is the path of a byte-level BPE file on the driver; its text travels with
    the tasks. Whole texts are encoded; a special token's string in a text becomes its id,
    as by default in the tokenizers library. Null and empty texts have an empty binary, an
    empty table gives an empty result, repeated rows stay apart, and a column already
    called ``ids_col`` is replaced. No row is shuffled.
    """
    return df.withColumn(ids_col, encode_column(named(text_col), read_vocabulary(tokenizer)))


def decode(
    df: DataFrame, tokenizer: str, ids_col: str = "token_ids", text_col: str = "decoded"
) -> DataFrame:
    """``df`` with the text of ``ids_col`` in ``text_col``; see ``decode_column``.

    A column already called ``text_col`` is replaced; null ids give the empty text.
    """
    return df.withColumn(text_col, decode_column(named(ids_col), read_vocabulary(tokenizer)))


def round_trip(
    df: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "token_ids",
    decoded_col: str = "decoded",
) -> DataFrame:
    """``decode(encode(df))`` in one pass: ``df`` with ``ids_col`` and ``decoded_col``.

    Nulls, empty texts, repeated rows and columns of those names are treated as there.
    """
    pair = fresh(df, "pair")[0]
    out = df.withColumn(pair, round_trip_column(named(text_col), read_vocabulary(tokenizer)))
    out = out.withColumn(ids_col, F.col(pair)["token_ids"])
    return out.withColumn(decoded_col, F.col(pair)["decoded"]).drop(pair)

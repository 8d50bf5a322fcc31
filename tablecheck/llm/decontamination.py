"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur with up to ``rate`` edits per character. Cut into one piece more than
that budget, at least one piece occurs unchanged. All pieces are found in one pass over
a text by an Aho-Corasick automaton; around each hit Myers' bit-parallel algorithm gives the
least edit distance between the item and any part of the text there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.llm.helpers import fresh, named

RATE = 0.06
#: Items are matched in blocks of about so many characters; a block travels with the tasks.
BLOCK_CHARS = 4_000_000
MATCH = T.ArrayType(
    T.StructType().add("item", "integer").add("start", "long").add("end", "long").add("distance", "integer")
)


def plain(text: str | None) -> str:
    """Lower case, with each run of white space as one blank."""
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): ``budget`` + 1 pieces of nearly equal length."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distances(pattern: dict[str, int], m: int, text: str, anchored: bool) -> Iterator[int]:
    """After each character of ``text``, the distance of the pattern to the text ending there.

    The matched text begins anywhere, or with ``anchored`` at the first character.
    """
    ones, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = ones, 0, m
    for c in text:
        eq = pattern.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right = down | (ones & ~(diagonal | up))
        left = up & diagonal
        score += bool(right & top) - bool(left & top)
        right = (right << 1 | anchored) & ones
        left = left << 1 & ones
        up = left | (ones & ~((eq | down) | right))
        down = right & (eq | down)
        yield score


class Matcher:
    """Finds a block of items in texts; built once in each task."""

    def __init__(self, items: list[str], rate: float):
        import ahocorasick

        self.items = [plain(i) for i in items]
        self.budgets = [int(rate * len(i)) for i in self.items]
        self.masks: dict[int, tuple] = {}
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            for offset, piece in pieces(item, self.budgets[k]) if item else []:
                owners.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, who in owners.items():
            self.automaton.add_word(piece, (len(piece), who))
        if owners:
            self.automaton.make_automaton()

    def verify(self, k: int, text: str, low: int, high: int) -> tuple | None:
        """The best match of item k whose diagonal lies between low and high."""
        item, budget = self.items[k], self.budgets[k]
        if k not in self.masks:
            self.masks[k] = masks(item), masks(item[::-1])
        m, begin = len(item), max(0, low - budget)
        window = text[begin : high + m + budget]
        least, end = budget + 1, 0
        for i, d in enumerate(distances(self.masks[k][0], m, window, False)):
            if d < least:
                least, end = d, i + 1
        if least > budget:
            return None
        back = window[max(0, end - m - budget) : end][::-1]
        length = 0
        for i, d in enumerate(distances(self.masks[k][1], m, back, True)):
            if d == least:
                length = i + 1
                break
        return k, begin + end - length, begin + end, least

    def find(self, raw: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, distance) in the plain text; one for each place of an item."""
        text = plain(raw)
        if not text or not len(self.automaton):
            return []
        diagonals: dict[int, set[int]] = {}
        for last, (size, who) in self.automaton.iter(text):
            for k, offset in who:
                diagonals.setdefault(k, set()).add(last - size + 1 - offset)
        out = []
        for k, found in sorted(diagonals.items()):
            item, reach = self.items[k], 2 * self.budgets[k]
            group: list[int] = []
            for d in [*sorted(found), None]:
                if group and (d is None or d - group[-1] > reach):
                    low, high = group[0], group[-1]
                    if low == high and text.startswith(item, low):
                        out.append((k, low, low + len(item), 0))
                    elif hit := self.verify(k, text, low, high):
                        out.append(hit)
                    group = []
                group.append(d)
        return sorted(set(out))


def match_column(text: Column, items: list[str], rate: float) -> Column:
    """Array of (item, start, end, distance): where texts hold the items (by position)."""

    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(items, rate)
        kind = pa.list_(pa.struct([("item", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
                                   ("distance", pa.int32())]))
        names = ("item", "start", "end", "distance")
        for batch in batches:
            yield pa.array([[dict(zip(names, m)) for m in matcher.find(t.as_py())] for t in batch], kind)

    return F.arrow_udf(match, MATCH)(text)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[tuple]:
    """The items as (ids, texts), block by block; items without words are left out."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(named(item_col), named(text_col)).toLocalIterator():
        if plain(row[1]):
            ids.append(row[0])
            texts.append(row[1])
            size += len(row[1])
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    yield ids, texts


def find_leaks(
    df: DataFrame, benchmark: DataFrame, *, rate: float = RATE, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    block: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, start, end, distance): every place where a text holds an item.

    Texts and items are compared in lower case with white space as one blank; start and end
    count characters of the text in that form. An item of n characters may differ by
    int(rate * n) edits. Places of one item whose hits lie within twice that budget are
    one, given by their best match. Null and empty texts and items match nothing; null
    ids are kept, repeated rows give repeated matches, and repeated items match each. The
    items are a query set: each block of them is one pass over all rows, without a shuffle.
    """
    out = None
    kind = benchmark.schema[item_col].dataType
    for ids, texts in item_blocks(benchmark, item_col, item_text_col, block):
        places = df.select(
            named(id_col).alias("doc_id"),
            F.explode(match_column(named(text_col), texts, rate)).alias("m"),
        )
        known = F.array(*[F.lit(i).cast(kind) for i in ids]).cast(T.ArrayType(kind))
        found = places.select(
            "doc_id", F.get(known, F.col("m.item")).alias("item_id"), "m.start", "m.end", "m.distance"
        )
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(
    df: DataFrame, benchmark: DataFrame, *, rate: float = RATE, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``df`` whose text holds no item; see ``find_leaks``. Columns stay."""
    for _, texts in item_blocks(benchmark, item_col, item_text_col, block):
        (hits,) = fresh(df, "hits")
        df = df.withColumn(hits, match_column(named(text_col), texts, rate))
        df = df.where(F.size(hits) == 0).drop(hits)
    return df

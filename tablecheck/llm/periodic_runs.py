"""Periodic runs of words, found on a Re-Pair grammar.

A run is a stretch of words that repeats with its smallest period, long enough, and that no
neighbouring word continues. Every run holds windows of words that recur in its text, so only
words under a recurring window go on. Their ids are compressed by Re-Pair over a block of texts:
the most frequent pair of neighbours becomes a new symbol, the oldest pair first among equally
frequent ones, until no pair recurs; what is left of each stretch is read as a balanced binary
tree. Each rule has one boundary, between its two parts. The runs that cross it are computed
once for each rule and moved to all places where the rule is derived. A run lies whole in the least rule
around it, so merging the overlapping finds of one period gives the maximal runs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.llm.helpers import fresh, named, offsets

MIN_LENGTH = 12
#: Characters of the texts that are worked on together; a longer text is worked on alone.
BLOCK_CHARS = 2_000_000
#: Pairs of equal windows that are extended together.
PAIRS_AT_ONCE = 250_000
#: Each level of window codes has windows this many times as long as the one below.
GROWTH = 8

_LOW = (1 << 32) - 1


@dataclass
class Runs:
    """Runs as arrays: text number, first word, words, smallest period; by text, start, period."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer of splitmix; wraps."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def recurring(ids: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Marks the words under a window of ``width`` words that its text has more than once.

    Windows are compared by hashes. A collision marks more words, never fewer.
    """
    codes = _mixed(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    n = len(ids) - width + 1
    marked = np.zeros(len(ids), bool)
    if n < 1:
        return marked
    window, factor = np.zeros(n, np.uint64), np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        window = window * factor + codes[k : k + n]
    text = np.repeat(np.arange(len(sizes)), sizes)[:n].astype(np.uint64)
    window = window ^ _mixed(text + np.uint64(1))
    room = np.repeat(offsets(sizes) + sizes, sizes)[:n]
    at = np.flatnonzero(np.arange(n) + width <= room)
    order = np.argsort(window[at])
    ordered = window[at][order]
    same = ordered[1:] == ordered[:-1]
    again = np.zeros(len(at), bool)
    again[1:] |= same
    again[:-1] |= same
    edge = np.zeros(len(ids) + 1, np.int64)
    found = at[order[again]]
    np.add.at(edge, found, 1)
    np.add.at(edge, found + width, -1)
    return np.cumsum(edge[:-1]) > 0


def re_pair(sequence: np.ndarray, first_new: int) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """Left and right parts of the rules of a Re-Pair grammar, and what is left of the sequence
    as symbols and the places where they begin. Rule ``r`` is the symbol ``first_new + r``.
    """
    n = len(sequence)
    value = sequence.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = sequence[:-1].astype(np.int64) << 32 | sequence[1:]
    order = np.argsort(pairs, kind="stable")
    ordered = pairs[order]
    begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if n > 1 else np.zeros(0, int)
    size = np.diff(np.append(begin, len(ordered)))
    often = size > 1
    where, count, heap = {}, {}, []
    for b, s in zip(begin[often].tolist(), size[often].tolist()):
        pair, spots = int(ordered[b]), order[b : b + s]
        where[pair], count[pair] = spots, s
        heap.append((-s, int(spots[0]), pair))
    heapq.heapify(heap)
    left, right, age = [], [], n
    while heap:
        minus, born, pair = heapq.heappop(heap)
        now = count.get(pair, 0)
        if now != -minus:  # occurrences went since; wait for the turn of the pairs with as few
            if now > 1:
                heapq.heappush(heap, (-now, born, pair))
            continue
        spots = where.pop(pair)
        del count[pair]
        a, b = pair >> 32, pair & _LOW
        places, taken = [], -1
        for p in spots if isinstance(spots, list) else spots.tolist():
            if p > taken and value[p] == a:
                q = after[p]
                if q < n and value[q] == b:
                    places.append(p)
                    taken = q
        if len(places) < 2:
            continue
        symbol = first_new + len(left)
        left.append(a)
        right.append(b)
        found: dict[int, list[int]] = {}
        for p in places:
            q = after[p]
            r, l = after[q], before[p]
            if l >= 0:
                v = value[l] << 32
                if v | a in count:
                    count[v | a] -= 1
                new = v | symbol
                if new in found:
                    found[new].append(l)
                    count[new] += 1
                else:
                    found[new], count[new] = [l], 1
            if r < n:
                v = value[r]
                if b << 32 | v in count:
                    count[b << 32 | v] -= 1
                new = symbol << 32 | v
                if new in found:
                    found[new].append(p)
                    count[new] += 1
                else:
                    found[new], count[new] = [p], 1
                before[r] = p
            value[p], value[q], after[p] = symbol, -1, r
        for new, spots in found.items():
            if count[new] > 1:
                where[new] = spots
                heapq.heappush(heap, (-count[new], age, new))
                age += 1
            else:
                del count[new]
    kept = np.array(value, np.int64)
    starts = np.flatnonzero(kept >= 0)
    return left, right, kept[starts], starts


@dataclass
class Grammar:
    """Binary rules over terminals 0 to ``terminals - 1``, and a symbol for each stretch."""

    terminals: int
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray  # words of each symbol, terminals first
    tops: np.ndarray


def build_grammar(sequence: np.ndarray, terminals: int, stretch: np.ndarray) -> Grammar:
    """A Re-Pair grammar of stretches of words that lie one after another in ``sequence``.

    ``stretch`` has the number of each word's stretch. A terminal of its own ends each stretch
    while pairs are replaced, so that no rule goes over an end.
    """
    ends = np.flatnonzero(np.append(stretch[1:] != stretch[:-1], True))
    n = len(ends)
    parted = np.insert(sequence, ends + 1, terminals + np.arange(n))
    left, right, symbols, starts = re_pair(parted, terminals + n)
    word = (symbols < terminals) | (symbols >= terminals + n)
    owner = np.searchsorted(ends + 1 + np.arange(n), starts[word])
    symbols = symbols[word]
    # The separators are no symbols of the grammar, so rules are numbered from ``terminals`` on.
    down = lambda s: np.where(s >= terminals, s - n, s)
    lefts, rights = [down(np.array(left, np.int64))], [down(np.array(right, np.int64))]
    symbols, made = down(symbols), terminals + len(left)
    while len(symbols) > n:
        place = np.arange(len(symbols)) - np.searchsorted(owner, owner)
        last = np.append(owner[1:] != owner[:-1], True)
        first = (place % 2 == 0) & ~last
        lefts.append(symbols[first])
        rights.append(symbols[np.flatnonzero(first) + 1])
        symbols = symbols.copy()
        symbols[first] = made + np.arange(first.sum())
        made += int(first.sum())
        keep = place % 2 == 0
        symbols, owner = symbols[keep], owner[keep]
    lefts, rights = np.concatenate(lefts), np.concatenate(rights)
    size = [1] * terminals
    for l, r in zip(lefts.tolist(), rights.tolist()):
        size.append(size[l] + size[r])
    return Grammar(terminals, lefts, rights, np.array(size, np.int64), symbols)


def derivations(grammar: Grammar, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(rule, place) of every place where a rule of at least ``least`` words is derived."""
    rules, places = [], []
    symbol, at = grammar.tops, starts
    while len(symbol):
        inner = (symbol >= grammar.terminals) & (grammar.size[symbol] >= least)
        rule, at = symbol[inner] - grammar.terminals, at[inner]
        rules.append(rule)
        places.append(at)
        l, r = grammar.left[rule], grammar.right[rule]
        symbol, at = np.concatenate([l, r]), np.concatenate([at, at + grammar.size[l]])
    return np.concatenate(rules), np.concatenate(places)


def _pair_codes(one: np.ndarray, shift: int) -> np.ndarray:
    """Exact codes of windows that are a window and the one ``shift`` words on.

    Beyond the end every place is different from all others.
    """
    n = len(one)
    other = np.arange(n) + n
    other[: max(n - shift, 0)] = one[shift:]
    return np.unique(one * (2 * n) + other, return_inverse=True)[1].astype(np.int64)


def window_codes(ids: np.ndarray, base: int, longest: int) -> list[tuple[int, np.ndarray]]:
    """(width, code of the window from each place on) for single words, ``base`` words and windows
    GROWTH times as long each; equal codes are equal windows."""
    levels = [(1, ids)]
    width, codes = 1, ids
    while width < base:
        step = min(width, base - width)
        codes = _pair_codes(codes, step)
        width += step
    if base > 1:
        levels.append((base, codes))
    while width * GROWTH <= longest:
        for _ in range(GROWTH.bit_length() - 1):
            codes = _pair_codes(codes, width)
            width *= 2
        levels.append((width, codes))
    return levels


def _extent(levels, one: np.ndarray, other: np.ndarray, stop: np.ndarray, ahead: bool) -> np.ndarray:
    """How many words from ``one`` and ``other`` on (or back) are equal, up to ``stop``.

    Ahead, ``other`` stays below ``stop``; back, words before ``one`` stay from ``stop`` on.
    """
    length = np.zeros(len(one), np.int64)
    for width, codes in reversed(levels):
        live = np.arange(len(one))
        while len(live):
            k = length[live]
            if ahead:
                live = live[other[live] + k + width <= stop[live]]
                k = length[live]
                same = codes[one[live] + k] == codes[other[live] + k]
            else:
                live = live[one[live] - k - width >= stop[live]]
                k = length[live] + width
                same = codes[one[live] - k] == codes[other[live] - k]
            live = live[same]
            length[live] += width
    return length


def _boundary_runs(
    rule: np.ndarray, begin: np.ndarray, cut: np.ndarray, end: np.ndarray, levels, width: int, min_length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rule, start, end, period) of the runs in ``begin`` to ``end`` that go over ``cut``.

    The words of such a run that equal the word a period on are at least ``width`` neighbours,
    and they, or the words a period behind them, hold the word at the cut. So each run is seen
    from a window with that word that recurs a period away within the rule.
    """
    codes = dict(levels)[width]
    n = len(codes)
    by_code = np.argsort(codes, kind="stable")
    keys = codes[by_code] * n + by_code
    low = np.maximum(begin, cut - width + 1)
    sizes = np.maximum(np.minimum(cut, end - width) - low + 1, 0)
    at = np.repeat(np.arange(len(rule)), sizes)
    place = np.repeat(low - offsets(sizes), sizes) + np.arange(sizes.sum())
    first = np.searchsorted(keys, codes[place] * n + begin[at])
    found = np.searchsorted(keys, codes[place] * n + end[at] - width, side="right") - first
    out = []
    # Windows are taken in slices that make a bounded number of pairs.
    slices = np.searchsorted(np.cumsum(found), np.arange(0, found.sum() + 1, PAIRS_AT_ONCE), side="right")
    for i, j in zip(slices, [*slices[1:], len(found)]):
        if i == j:
            continue
        times = found[i:j]
        mine = np.repeat(np.arange(i, j), times)
        there = by_code[np.repeat(first[i:j] - offsets(times), times) + np.arange(times.sum())]
        here, r = place[mine], at[mine]
        # Of windows that recur side by side the first one stands for all.
        earlier = (here > low[r]) & (there > begin[r])
        earlier &= codes[here - 1] == codes[np.maximum(there - 1, 0)]
        new = (here != there) & ~earlier
        here, there, r = here[new], there[new], r[new]
        one, other = np.minimum(here, there), np.maximum(here, there)
        period = other - one
        back = _extent(levels, one, other, begin[r], ahead=False)
        on = _extent(levels, one + width, other + width, end[r], ahead=True)
        start, stop = one - back, other + width + on
        run = (stop - start >= np.maximum(min_length, 2 * period)) & (start < cut[r]) & (stop > cut[r])
        out.append(np.stack([rule[r], start, stop, period])[:, run])
    if not out:
        return tuple(np.zeros((4, 0), np.int64))
    rule, start, stop, period = np.concatenate(out, axis=1)
    # One stretch has multiples of its smallest period too.
    order = np.lexsort([period, stop, start, rule])
    rule, start, stop, period = rule[order], start[order], stop[order], period[order]
    same = (rule[1:] == rule[:-1]) & (start[1:] == start[:-1]) & (stop[1:] == stop[:-1])
    least = np.append(True, ~same) if len(rule) else np.zeros(0, bool)
    return rule[least], start[least], stop[least], period[least]


def _merged(text, start, stop, period) -> tuple[np.ndarray, ...]:
    """Stretches of one text and period that share a period's length become one."""
    order = np.lexsort([-stop, start, period, text])
    text, start, stop, period = text[order], start[order], stop[order], period[order]
    if not len(text):
        return text, start, stop, period
    group = np.cumsum(np.append(False, (text[1:] != text[:-1]) | (period[1:] != period[:-1])))
    lift = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + group * lift) - group * lift
    begins = np.append(True, (group[1:] != group[:-1]) | (start[1:] + period[1:] > reach[:-1]))
    ends = np.append(np.flatnonzero(begins)[1:] - 1, len(text) - 1)
    return text[begins], start[begins], reach[ends], period[begins]


def find_runs(ids: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH) -> Runs:
    """The runs of texts whose word ids lie one after another, ``sizes`` words each."""
    width = (min_length + 1) // 2
    none = np.zeros(0, np.int64)
    marked = recurring(ids, sizes, width)
    kept = np.flatnonzero(marked)
    if not len(kept):
        return Runs(none, none, none, none)
    owner = np.searchsorted(np.cumsum(sizes), kept, side="right")
    stretch = np.cumsum(np.append(False, (kept[1:] != kept[:-1] + 1) | (owner[1:] != owner[:-1])))
    terms, words = np.unique(ids[kept], return_inverse=True)
    words = words.astype(np.int64)
    grammar = build_grammar(words, len(terms), stretch)
    starts = np.searchsorted(stretch, np.arange(stretch[-1] + 1))
    rules, places = derivations(grammar, starts, min_length)
    order = np.lexsort([places, rules])
    rules, places = rules[order], places[order]
    rule, at, times = np.unique(rules, return_index=True, return_counts=True)
    begin = places[at]
    cut = begin + grammar.size[grammar.left[rule]]
    end = begin + grammar.size[rule + grammar.terminals]
    # Stretches do not touch in codes: a window over the end of one is like no other.
    parted = np.insert(words, np.flatnonzero(np.diff(stretch)) + 1, len(terms) + np.arange(stretch[-1]))
    moved = np.arange(len(words)) + stretch
    levels = window_codes(parted, width, int((end - begin).max(initial=1)))
    shift = stretch[begin] if len(begin) else none
    r, start, stop, period = _boundary_runs(
        np.arange(len(rule)), begin + shift, cut + shift, end + shift, levels, width, min_length
    )
    # From the first place of each rule to all its places.
    copies = times[r]
    where = places[np.repeat(at[r] - offsets(copies), copies) + np.arange(copies.sum())]
    start = where + np.repeat(start - moved[begin[r]], copies)
    stop = where + np.repeat(stop - moved[begin[r]], copies)
    text = owner[where] if len(where) else none
    text, start, stop, period = _merged(text, start, stop, np.repeat(period, copies))
    length = stop - start
    start = kept[start] - offsets(sizes)[text]
    order = np.lexsort([period, start, text])
    return Runs(text[order], start[order], length[order], period[order])


def repeated_words(runs: Runs, sizes: np.ndarray) -> np.ndarray:
    """Marks the words that a run contains after its first period."""
    edge = np.zeros(int(sizes.sum()) + 1, np.int64)
    start = offsets(sizes)[runs.text] + runs.start
    np.add.at(edge, start + runs.period, 1)
    np.add.at(edge, start + runs.length, -1)
    return np.cumsum(edge[:-1]) > 0


def runs_column(text: Column, min_length: int = MIN_LENGTH) -> Column:
    """Struct of ``runs``, an array of (start, length, period), and ``collapsed``; see ``add_runs``."""
    run = T.StructType().add("start", "long").add("length", "long").add("period", "long")
    kind = T.StructType().add("runs", T.ArrayType(run)).add("collapsed", T.StringType())

    def work(texts: list[list[bytes]]) -> pa.StructArray:
        codes: dict[bytes, int] = {}
        sizes = np.array([len(words) for words in texts], np.int64)
        ids = np.fromiter(
            (codes.setdefault(w, len(codes)) for words in texts for w in words), np.int64, int(sizes.sum())
        )
        found = find_runs(ids, sizes, min_length)
        gone, at = repeated_words(found, sizes), offsets(sizes)
        some, out = set(found.text.tolist()), []
        for i, words in enumerate(texts):
            if i in some:
                lost = gone[at[i] : at[i] + sizes[i]].tolist()
                words = [w for w, x in zip(words, lost) if not x]
            out.append(b" ".join(words))
        ends = np.searchsorted(found.text, np.arange(len(texts) + 1))
        rows = pa.StructArray.from_arrays(
            [pa.array(a, pa.int64()) for a in (found.start, found.length, found.period)],
            ["start", "length", "period"],
        )
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
        return pa.StructArray.from_arrays([lists, pa.array(out, pa.string())], ["runs", "collapsed"])

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            block, size = [], 0
            for value in batch.cast(pa.binary()):
                raw = value.as_py() or b""
                if block and size + len(raw) > BLOCK_CHARS:
                    yield work(block)
                    block, size = [], 0
                block.append(raw.split())  # bytes split at ASCII white space only
                size += len(raw)
            if block or not len(batch):
                yield work(block)

    return F.arrow_udf(apply, kind)(text)


def add_runs(
    df: DataFrame, *, min_length: int = MIN_LENGTH, text_col: str = "text", runs_col: str = "runs",
    collapsed_col: str = "collapsed",
) -> DataFrame:
    """``df`` with the periodic runs of ``text_col`` and the text without their repetitions.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of words with
    smallest period q (words q apart are equal) of at least max(``min_length``, 2q) words that
    no neighbouring word extends. ``runs_col`` is an array of structs (start, length, period) by
    start, then period. ``collapsed_col`` has the words joined by a blank, without those that some
    run contains after its first q words.

    Null and empty texts have no runs and collapse to the empty text; whole texts are read,
    of any length, in memory of some 300 bytes for each word that lies under a recurring window of its text.
    Repeated rows stay apart, an empty table gives an empty result, other columns are kept, and
    columns already called ``runs_col`` or ``collapsed_col`` are replaced. No row is shuffled.
    """
    if min_length < 2:
        raise ValueError("min_length must be at least 2")
    (both,) = fresh(df, "both")
    out = df.withColumn(both, runs_column(named(text_col), min_length))
    out = out.withColumn(runs_col, F.col(both)["runs"])
    return out.withColumn(collapsed_col, F.col(both)["collapsed"]).drop(both)

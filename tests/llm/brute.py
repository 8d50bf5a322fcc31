"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import xxhash
from tokenizers import Tokenizer


def table(sf_dir: str, name: str) -> list[dict]:
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


def tokenizer(name: str) -> Tokenizer:
    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.no_truncation()
    found.no_padding()
    return found


def token_ids(texts: list[str | None], name: str) -> list[list[int]]:
    found = tokenizer(name).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [e.ids for e in found]


def as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def fingerprint(text: str | None, width: int = 4) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(rows: list[tuple], radius: int = 4) -> dict:
    """id to least id reachable, from (id, fingerprint)."""
    label = {i: i for i, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (i, f) in enumerate(rows):
        for j, g in rows[k + 1 :]:
            if (f ^ g).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: root(i) for i, _ in rows}


def measures(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


def edit_distance(pattern: str, text: str) -> int:
    """Least edit distance of the pattern to any part of the text."""
    above = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(above[j - 1] + (p != t), above[j] + 1, row[-1] + 1))
        above = row
    return min(above)


def crc32(text: str | None) -> int:
    return zlib.crc32((text or "").encode())


def pieces(words: list[str], reach: int) -> list[int]:
    """Word numbers at which the pieces of a long sentence begin, and its number of words."""
    codes = [zlib.crc32(b.encode(), zlib.crc32(a.encode())) for a, b in zip(words, words[1:])]
    chosen = []
    for w in range(len(codes) - reach + 1):
        window = range(w, w + reach)
        least = [k for k in window if codes[k] == min(codes[w : w + reach])]
        # A place that was chosen last stays while it is among the least.
        if not chosen or chosen[-1] not in least:
            chosen.append(least[-1])
    return [0, *(k + 1 for k in chosen), len(words)]


def shortest(lengths: list[int], units: int, words: int, starts, ends) -> set[tuple[int, int]]:
    """The shortest run from each of ``starts`` on and up to each of ``ends``."""
    n, out = len(lengths), set()
    enough = lambda i, j: j - i >= units and sum(lengths[i:j]) >= words
    for i in starts:
        out.update([(i, j) for j in range(i, n + 1) if enough(i, j)][:1])
    for j in ends:
        out.update([(i, j) for i in range(j, -1, -1) if enough(i, j)][:1])
    return out


def without_repeats(
    rows: list[tuple], min_sentences: int, min_words: int, reach: int, piece_words: int
) -> dict:
    """id to text without what a run that occurs before covers, from (id, text) with unique ids."""
    first, out = {}, {}
    for doc, text in sorted(rows):
        text = text or ""
        ends = [m.end() for m in re.finditer(r"((?<=[.!?])[^\S\n]|\n)\s*", text)]
        said = [(a, b) for a, b in zip([0, *ends], [*ends, len(text)]) if text[a:b].split()]
        units, cut, closed = [], [], []
        for a, b in said:
            starts = [a + m.start() for m in re.finditer(r"\S+", text[a:b])]
            if len(starts) <= reach:
                units.append((a, b))
                cut.append(False)
                continue
            at = pieces(text[a:b].lower().split(), reach)
            places = [a, *(starts[k] for k in at[1:-1]), b]
            units += zip(places, places[1:])
            cut += [True] * (len(places) - 1)
            closed.append(len(units))
        found = []
        count = lambda spans: [len(text[a:b].split()) for a, b in spans]
        words = lambda spans: tuple(" ".join(text[a:b].lower().split()) for a, b in spans)
        every = range(len(said) + 1)
        for i, j in shortest(count(said), min_sentences, min_words, every, every):
            found.append((said[i][0], said[j - 1][1], words(said[i:j]), False))
        for i, j in shortest(count(units), 2, piece_words, range(len(units)), closed):
            if any(cut[i:j]):
                key = words(units[i:j])
                found.append((units[i][0], units[j - 1][1], key, len(set(key)) == 1))
        gone, mine, dull = [False] * len(text), set(), {}
        for a, b, key, same in found:
            dull[a, b, key] = dull.get((a, b, key), False) or same
        for (a, b, key), same in sorted(dull.items()):
            if first.setdefault(key, doc) != doc or (key in mine and not same):
                gone[a:b] = [True] * (b - a)
            mine.add(key)
        out[doc] = "".join(c for c, x in zip(text, gone) if not x)
    return out


def outlier_distances(rows: list[tuple], floors, grain, share, steps, median_chi2) -> dict:
    """id to scaled squared distance, from (id, group, measures) that pass the base rule."""
    groups: dict = {}
    for i, group, (words, chars, symbols, lines, repeated) in rows:
        n = max(words, 1)
        x = [np.log(n), np.log(max(chars, 1) / n), *(np.log1p(100 * v / n) for v in (symbols, lines, repeated))]
        groups.setdefault(group, []).append((i, np.floor(np.array(x) * grain + 0.5)))
    floor, out = np.diag((np.array(floors) * grain) ** 2), {}
    for members in groups.values():
        x = np.array([m[1] for m in members])
        low = lambda v: np.sort(v, axis=0)[int(np.ceil(len(v) / 2)) - 1]
        mean, cov = low(x), np.diag((1.4826 * low(abs(x - low(x)))) ** 2)
        for step in range(steps + 1):
            apart = x - mean
            d2 = np.einsum("ij,ij->i", apart @ np.linalg.inv(cov + floor), apart)
            place = np.floor(np.log1p(d2) * grain + 0.5)
            if step < steps:
                near = x[place <= np.sort(place)[int(np.ceil(share * len(x))) - 1]]
                mean, cov = near.mean(axis=0), np.atleast_2d(np.cov(near.T, bias=True))
        middle = np.expm1(low(place) / grain)
        scale = min(1.0, median_chi2 / max(middle, 1e-9))
        out.update({m[0]: d * scale for m, d in zip(members, d2)})
    return out


def near_vectors(rows: list[tuple], threshold: float) -> dict:
    """id to (links, least id reachable) from (id, vector, label) with unique ids."""
    groups, out = {}, {}
    for i, vector, label in rows:
        able = vector and label is not None and all(x is not None and np.isfinite(x) for x in vector) and any(vector)
        if able:
            groups.setdefault((label, len(vector)), []).append((i, vector))
        else:
            out[i] = (0, i)
    for group in groups.values():
        ids = np.array([i for i, _ in group])
        unit = np.array([v for _, v in group], float)
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        near = unit @ unit.T >= threshold
        np.fill_diagonal(near, True)
        root, before = ids, None
        while before is None or (root != before).any():
            before, root = root, np.where(near, root, ids.max()).min(axis=1)
        out.update({i: (int(n) - 1, int(r)) for i, n, r in zip(ids.tolist(), near.sum(axis=1), root)})
    return out


def periodic_runs(words: list[str], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) by start, then period: each period compared word by word."""
    n, best = len(words), {}
    ids = np.unique(np.array([w.encode() for w in words], dtype=object), return_inverse=True)[1] if n else np.zeros(0)
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[False], ids[q:] == ids[:-q], [False]]).astype(np.int8)
        edges = np.flatnonzero(np.diff(same))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a + q >= max(least, 2 * q):
                best.setdefault((a, b - a + q), q)  # the smallest period comes first
    return sorted((start, length, q) for (start, length), q in best.items())

"""Hierarchical navigable small-world graphs of unit vectors, in arrays.

Nodes are inserted and queries run in batches, so that a step of the search is a few array
operations for all of them. Level 0 holds all nodes; each level above holds a share of the one below.
A node's neighbours are chosen for their directions: a candidate that is nearer to a chosen neighbour
than to the node waits behind those that are not, which keeps crowded places linked to the rest.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

#: Neighbours of a node; twice as many at level 0.
DEGREE = 16
#: Beam while a graph is built.
BUILD_BEAM = 64
#: Nodes that are inserted, and queries that run, together.
BATCH = 1024
#: Nodes that a query expands in one step.
STRIDE = 4
#: Numbers that one array operation of a search makes.
AT_ONCE = 4_000_000


@dataclass
class Graph:
    """``links[level]`` has a line of neighbours for each node, -1 where there are fewer."""

    vectors: np.ndarray  # float32, nodes of higher levels first
    links: list[np.ndarray]
    counts: list[int]  # nodes of each level: the first ones


def level_counts(n: int) -> list[int]:
    """How many nodes each level has; the levels of a node are fixed by its place."""
    counts = [n]
    while counts[-1] > DEGREE:
        counts.append(max(1, counts[-1] // DEGREE))
    return counts


def _choose(vectors: np.ndarray, candidates: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Up to ``degree`` of each line's candidates (-1: none), by descending similarity.

    First those that are more like the node than like any one chosen before, then the others.
    """
    order = np.argsort(-sims, axis=1, kind="stable")
    candidates = np.take_along_axis(candidates, order, 1)
    sims = np.take_along_axis(sims, order, 1)
    n, width = candidates.shape
    near = vectors[np.maximum(candidates, 0)]
    between = near @ near.transpose(0, 2, 1)
    real = candidates >= 0
    chosen = np.zeros((n, width), bool)
    for k in range(width):
        other = np.where(chosen[:, :k], between[:, k, :k], -2).max(axis=1, initial=-2)
        chosen[:, k] = real[:, k] & (other < sims[:, k]) & (chosen[:, :k].sum(axis=1) < degree)
    rank = np.argsort(np.where(chosen, 0, np.where(real, 1, 2)), axis=1, kind="stable")
    out = np.take_along_axis(candidates, rank, 1)[:, :degree]
    if out.shape[1] < degree:
        out = np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)
    return out


def likeness(one: np.ndarray, i: np.ndarray, other: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the lines ``one[i]`` and ``other[j]``, some at a time."""
    step = max(1, AT_ONCE // max(1, one.shape[1]))
    parts = [
        np.einsum("ij,ij->i", one[i[k : k + step]], other[j[k : k + step]]) for k in range(0, len(i), step)
    ]
    return np.concatenate(parts) if parts else np.zeros(0, one.dtype)


def _unseen(
    links: np.ndarray, lines: np.ndarray, source: np.ndarray, total: int, seen: np.ndarray, stamp: np.ndarray
) -> np.ndarray:
    """line * total + node, each once, of the neighbours of ``source`` that are new to their line.

    They are marked in ``seen``. The last of equal ones that wrote its number to ``stamp`` stays.
    """
    step, found = max(1, AT_ONCE // links.shape[1]), []
    for k in range(0, len(source), step):
        to = links[source[k : k + step]]
        code = ((lines[k : k + step] * total)[:, None] + to)[(to >= 0) & (to < total)]
        code = code[seen[code] == -2]
        number = np.arange(len(code), dtype=np.int32)
        stamp[code] = number
        code = code[stamp[code] == number]
        seen[code] = -3
        found.append(code)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def search(
    graph: Graph, queries: np.ndarray, level: int, entries: np.ndarray, beam: int, floor: float = 2.0,
    present: int | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``beam`` most similar nodes found for each query, and which nodes were looked at.

    Starts from the nodes ``entries`` of each query (-1: none). A node is expanded while it is
    among the ``beam`` best; any node of similarity ``floor`` or more is expanded too, so the
    beam is as wide as there are such nodes. Returns nodes (-1: none), similarities, and
    a matrix of similarities to every node looked at (-2 where it was not).
    """
    vectors, links = graph.vectors, graph.links[level]
    total, n = present if present is not None else graph.counts[level], len(queries)
    seen = np.full((n, total), np.float32(-2))
    beam = min(beam, total)
    stride = min(STRIDE, beam)
    best = np.full((n, beam), -1, np.int64)
    sims = np.full((n, beam), np.float32(-2))
    waiting = np.zeros((n, beam), bool)
    lines, columns = np.nonzero(entries >= 0)
    flat, stamp, worst = seen.reshape(-1), np.empty(seen.size, np.int32), np.full(n, np.float32(-2))
    code = np.unique(lines * total + entries[lines, columns])
    while len(code):
        lines = code // total
        nodes = code - lines * total
        like = likeness(queries, lines, vectors, nodes)
        flat[code] = like
        # Whatever is close enough is expanded at once, however many that are.
        close = like >= floor
        near_lines, near_nodes = lines[close], nodes[close]
        # The best of the others and of the beam are the new beam.
        better = like > worst[lines]
        lines, nodes, like, close = lines[better], nodes[better], like[better], close[better]
        order = np.lexsort([-like, lines])
        lines, nodes, like, close = lines[order], nodes[order], like[order], close[order]
        ids, first, sizes = np.unique(lines, return_index=True, return_counts=True)
        place = np.arange(len(lines)) - np.repeat(first, sizes)
        top = place < beam
        at, place = np.repeat(np.arange(len(ids)), sizes)[top], place[top]
        wide = (len(ids), beam + int(place.max(initial=-1)) + 1)
        held, value, free = np.full(wide, -1, np.int64), np.full(wide, np.float32(-2)), np.zeros(wide, bool)
        held[:, :beam], value[:, :beam], free[:, :beam] = best[ids], sims[ids], waiting[ids]
        held[at, beam + place], value[at, beam + place], free[at, beam + place] = nodes[top], like[top], ~close[top]
        if wide[1] > beam:
            kept = np.argpartition(-value, beam - 1, axis=1)[:, :beam]
            best[ids], sims[ids], waiting[ids] = (np.take_along_axis(x, kept, 1) for x in (held, value, free))
            worst[ids] = sims[ids].min(axis=1)
        # Expand the best that wait, and what is close.
        live = np.flatnonzero(waiting.any(axis=1))
        value = np.where(waiting[live], sims[live], -2)
        pick = np.tile(np.arange(beam), (len(live), 1))
        if stride < beam:
            pick = np.argpartition(-value, stride - 1, axis=1)[:, :stride]
        r, c = np.nonzero(np.take_along_axis(value, pick, 1) > -2)
        lines, columns = live[r], pick[r, c]
        waiting[lines, columns] = False
        source = np.append(best[lines, columns], near_nodes)
        lines = np.append(lines, near_lines)
        code = _unseen(links, lines, source, total, flat, stamp)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(best, order, 1), np.take_along_axis(sims, order, 1), seen


def _descend(graph: Graph, queries: np.ndarray, to: int, beam: int, present: list[int]) -> np.ndarray:
    """Entry nodes for a search at level ``to``, found level by level from the top."""
    entries = np.tile(np.arange(min(present[-1], DEGREE)), (len(queries), 1))
    for level in range(len(present) - 1, to, -1):
        if present[level]:
            entries, _, _ = search(graph, queries, level, entries, min(beam, DEGREE), present=present[level])
    return entries


def _connect(graph: Graph, level: int, nodes: np.ndarray, found: np.ndarray, sims: np.ndarray) -> None:
    """Link new ``nodes`` both ways with the best of what was found for them."""
    links, vectors = graph.links[level], graph.vectors
    degree = links.shape[1]
    links[nodes] = _choose(vectors, found, sims, degree)
    lines, columns = np.nonzero(links[nodes] >= 0)
    source, target = nodes[lines], links[nodes][lines, columns]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    ids, first, sizes = np.unique(target, return_index=True, return_counts=True)
    width = degree + int(sizes.max(initial=0))
    # Nodes with many new neighbours make wide lines, so lines of like width go together.
    for low in range(0, width, degree):
        some = np.flatnonzero((sizes > low) & (sizes <= low + degree))
        if not len(some):
            continue
        wide = np.full((len(some), degree + low + degree), -1, np.int64)
        wide[:, :degree] = links[ids[some]]
        at = np.repeat(np.arange(len(some)), sizes[some])
        place = np.arange(len(at)) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])
        wide[at, degree + place] = source[np.repeat(first[some], sizes[some]) + place]
        # The same neighbour may be there already.
        wide = -np.sort(-wide, axis=1)
        wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
        for part in range(0, len(some), BATCH):
            line, who = wide[part : part + BATCH], ids[some[part : part + BATCH]]
            like = np.einsum("ij,ikj->ik", vectors[who], vectors[np.maximum(line, 0)])
            links[who] = _choose(vectors, line, np.where(line >= 0, like, -2), degree)


def build(vectors: np.ndarray) -> Graph:
    """The graph of unit vectors in the order given, which should not follow their values."""
    vectors = np.ascontiguousarray(vectors, np.float32)
    n = len(vectors)
    counts = level_counts(n)
    links = [np.full((c, DEGREE * (2 if i == 0 else 1)), -1, np.int64) for i, c in enumerate(counts)]
    graph, done = Graph(vectors, links, counts), 0
    while done < n:
        size = min(n - done, max(DEGREE, min(done, BATCH)))
        nodes = np.arange(done, done + size)
        mine = vectors[nodes]
        before = [min(done, c) for c in counts]
        # Nodes of one batch do not see each other in the graph, so they are compared directly.
        near = mine @ mine.T
        np.fill_diagonal(near, -2)
        width = min(size, DEGREE)
        for level in range(len(counts)):
            new = nodes[nodes < counts[level]]
            if not len(new):
                continue
            k = len(new)
            here = near[:k, :k]
            few = min(width, k)
            peers = np.argpartition(-here, few - 1, axis=1)[:, :few]
            sims = np.take_along_axis(here, peers, 1)
            found, peers = np.zeros((k, 0), np.int64), np.where(sims > -2, peers + done, -1)
            if before[level]:
                entries = _descend(graph, mine[:k], level, DEGREE, [b for b in before if b])
                found, old, _ = search(graph, mine[:k], level, entries, BUILD_BEAM, present=before[level])
                sims = np.hstack([old, sims])
            _connect(graph, level, new, np.hstack([found, peers]), sims)
        done += size
    _reach_all(graph)
    return graph


def _reach_all(graph: Graph) -> None:
    """Give each node of level 0 that no path leads to a link from a neighbour that has one."""
    while True:
        links = graph.links[0]
        n = len(links)
        reached = np.zeros(n, bool)
        front = np.arange(min(n, DEGREE))
        while len(front):
            reached[front] = True
            to = np.unique(links[front])
            to = to[to >= 0]
            front = to[~reached[to]]
        lost = np.flatnonzero(~reached)
        to = links[lost]
        can = (to >= 0) & reached[np.maximum(to, 0)]
        some = can.any(axis=1)
        if not some.any():  # all are reached, or whole islands are left: link those to the entry
            if not len(lost):
                return
            some = np.arange(len(lost)) == 0
            source = np.zeros(1, np.int64)
        else:
            source = to[some, can[some].argmax(axis=1)]
        target = lost[some]
        order = np.argsort(source, kind="stable")
        source, target = source[order], target[order]
        ids, first, sizes = np.unique(source, return_index=True, return_counts=True)
        extra = np.full((n, int(sizes.max())), -1, np.int64)
        extra[source, np.arange(len(source)) - np.repeat(first, sizes)] = target
        graph.links[0] = np.hstack([links, extra])


def looked_at(
    graph: Graph, queries: np.ndarray, beam: int, floor: float, own: np.ndarray | None = None
) -> np.ndarray:
    """Similarities of the queries to the nodes of level 0 that a search looked at, -2 for others.

    ``own`` are the nodes of the queries themselves where these are in the graph.
    """
    entries = _descend(graph, queries, 0, max(DEGREE, beam // 4), graph.counts)
    if own is not None:
        entries = np.hstack([entries, own[:, None]])
    return search(graph, queries, 0, entries, beam, floor)[2]


def links_to_bytes(graph: Graph) -> bytes:
    out = io.BytesIO()
    np.savez(out, *[level.astype(np.int32) for level in graph.links])
    return out.getvalue()


def from_bytes(vectors: np.ndarray, data: bytes) -> Graph:
    held = np.load(io.BytesIO(data))
    links = [held[f"arr_{i}"].astype(np.int64) for i in range(len(held.files))]
    return Graph(np.ascontiguousarray(vectors, np.float32), links, [len(level) for level in links])

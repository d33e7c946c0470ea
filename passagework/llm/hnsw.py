"""Hierarchical navigable small-world graphs over the vectors of one shard, as flat neighbour arrays (numpy only).

Levels are built from the top: the few nodes of the highest level first, then each lower level, whose nodes enter in
growing batches. A batch is searched in the graph as it stands, from entries found in the level above; neighbours are
chosen for diversity, and links go back with the same choice where a list overflows. Searches of many queries run in
step over one beam array. Distances are squared Euclidean in the precision of the vectors.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

from passagework.llm.shared import mix

LINKS = 16
BUILD_BEAM = 96
QUERIES_AT_ONCE = 256
EXPAND = 4
_BRUTE = 256


@dataclass
class Graph:
    """``levels[0]`` is the lowest: neighbour numbers per node, -1 where a list ends. Upper levels list their nodes."""

    vectors: np.ndarray
    nodes: list
    levels: list

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, **{f"n{i}": n for i, n in enumerate(self.nodes)},
                 **{f"l{i}": n for i, n in enumerate(self.levels)})
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Graph:
        with np.load(io.BytesIO(data)) as f:
            n = sum(k.startswith("n") for k in f.files)
            return Graph(f["vectors"], [f[f"n{i}"] for i in range(n)], [f[f"l{i}"] for i in range(n)])


def build(vectors: np.ndarray, ids: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM) -> Graph:
    """Graph over ``vectors``; a node's level comes from the hash of its id, so a rebuilt shard is the same."""
    n = len(vectors)
    random = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(77))
    level = np.floor(-np.log((random >> np.uint64(11)).astype(np.float64) / 2**53 + 1e-18) / np.log(links)).astype(int)
    order = np.lexsort((random, -level))
    top = 0
    while n and (level > top).sum() >= links:
        top += 1
    nodes, levels, entries = [], [], None
    for at in range(top, -1, -1):
        members = order[:(level >= at).sum()] if at else order
        graph = _build_level(vectors, members, links * (1 if at else 2), beam, entries)
        nodes.insert(0, members)
        levels.insert(0, graph)
        entries = (nodes, levels)
    if n:  # lists of the lowest level by node number
        lowest = np.full((n, levels[0].shape[1]), -1, np.int32)
        lowest[nodes[0]] = levels[0]
        nodes[0], levels[0] = np.arange(n), lowest
    return Graph(vectors, nodes, levels)


def _distances(vectors, a, b):
    """Squared distances of rows ``a`` of queries to vectors ``b``."""
    d = vectors[b] - a
    return np.einsum("...i,...i->...", d, d)


def _build_level(vectors, members, width, beam, above):
    """Neighbour lists in the order of ``members``, whose first part is the level above."""
    n = len(members)
    local = vectors[members]
    lists = np.full((n, width), -1, np.int32)
    if above is not None:
        upper = len(above[0][0])
        position = np.full(len(vectors), -1, np.int64)
        position[members] = np.arange(n)
    else:
        upper = 0
    done = min(n, _BRUTE)
    if done > 1:
        first = np.arange(done)
        _link(local, lists, first, *_nearest(local, local[:done], first, done, min(beam, done - 1), own=True))
    while done < n:
        batch = np.arange(done, min(n, done + max(_BRUTE // 2, min(done // 4, 1024))))
        for lo in range(0, len(batch), QUERIES_AT_ONCE):
            some = batch[lo:lo + QUERIES_AT_ONCE]
            if upper and done >= upper:
                start = position[above[0][0]][_descend(vectors, above, local[some])]
            else:
                start = np.zeros(len(some), np.int64)
            ids, dist = beam_search(local, lists, local[some], start, beam)
            mates, near = _nearest(local, local[some], some, None, min(16, len(some) - 1), own=True)
            if mates.shape[1]:
                ids, dist = np.hstack([ids, mates]), np.hstack([dist, near])
                by = np.argsort(dist, axis=1, kind="stable")
                ids, dist = np.take_along_axis(ids, by, 1), np.take_along_axis(dist, by, 1)
            _link(local, lists, some, ids, dist)
        done = int(batch[-1]) + 1
    return np.where(lists >= 0, members[lists], -1).astype(np.int32)


def _nearest(local, queries, numbers, among, k, own=False):
    """Nearest of the first ``among`` nodes, or of the batch itself, by brute force."""
    pool = np.arange(among) if among is not None else numbers
    if k < 1:
        return np.empty((len(queries), 0), np.int64), np.empty((len(queries), 0), local.dtype)
    p = local[pool]
    dist = (queries**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * queries @ p.T
    if own:
        dist[numbers[:, None] == pool[None]] = np.inf
    by = np.argpartition(dist, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(dist, by, 1)
    inner = np.argsort(near, axis=1, kind="stable")
    by = np.take_along_axis(by, inner, 1)
    return pool[by], np.maximum(np.take_along_axis(near, inner, 1), 0)


def _diverse(local, ids, dist, width):
    """Per row the candidates (by distance) nearer to the row than to those chosen before, then the nearest others."""
    rows, k = ids.shape
    points = local[np.maximum(ids, 0)]
    norms = np.einsum("ijk,ijk->ij", points, points)
    between = norms[:, :, None] + norms[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
    chosen, nearest, count = np.zeros((rows, k), bool), np.full((rows, k), np.inf, dist.dtype), np.zeros(rows, int)
    valid = (ids >= 0) & np.isfinite(dist)
    for j in range(k):
        take = valid[:, j] & (count < width) & (dist[:, j] < nearest[:, j])
        if take.any():
            chosen[take, j] = True
            count += take
            nearest[take] = np.minimum(nearest[take], between[take, j])
    rank = np.where(valid, np.where(chosen, 0, 1) * k + np.arange(k), 4 * k)
    by = np.argsort(rank, axis=1, kind="stable")[:, :width]
    picked = np.where(np.take_along_axis(valid, by, 1), np.take_along_axis(ids, by, 1), -1)
    if picked.shape[1] < width:
        picked = np.pad(picked, ((0, 0), (0, width - picked.shape[1])), constant_values=-1)
    return picked


def _link(local, lists, new, ids, dist):
    """Set the lists of ``new`` nodes and add the links back."""
    width = lists.shape[1]
    forward = _diverse(local, ids[:, :4 * LINKS], dist[:, :4 * LINKS], max(1, width // 2))
    lists[new, :forward.shape[1]] = forward
    source = np.repeat(new, forward.shape[1])
    target = forward.ravel()
    source, target = source[target >= 0], target[target >= 0]
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
    most = int(counts.max()) if len(counts) else 0
    for lo in range(0, len(nodes), QUERIES_AT_ONCE):
        some = nodes[lo:lo + QUERIES_AT_ONCE]
        extra = np.full((len(some), most), -1, np.int64)
        for i, (f, c) in enumerate(zip(first[lo:lo + QUERIES_AT_ONCE].tolist(), counts[lo:lo + QUERIES_AT_ONCE].tolist())):
            extra[i, :c] = source[f:f + c]
        known = (extra[:, :, None] == lists[some][:, None, :]).any(2)
        both = np.hstack([lists[some], np.where(known, -1, extra)])
        gap = np.where(both >= 0, _distances(local, local[some][:, None, :], np.maximum(both, 0)), np.inf)
        by = np.argsort(gap, axis=1, kind="stable")[:, :width + 16]
        both, gap = np.take_along_axis(both, by, 1), np.take_along_axis(gap, by, 1)
        full = (both >= 0).sum(1) > width
        lists[some[~full]] = both[~full][:, :width]
        if full.any():
            lists[some[full]] = _diverse(local, both[full], gap[full], width)


def beam_search(vectors, lists, queries, start, beam, expand=None):
    """Nearest nodes found per query, ``(numbers, distances)`` by distance; -1 and inf where a beam isn't full.

    All queries run in step: each round opens the nearest unopened nodes of every beam that still has some.
    """
    nq, n = len(queries), len(lists)
    beam = max(1, min(beam, n))
    expand = expand or max(EXPAND, beam // 16)
    mark = np.full((nq, n), -1, np.int32)
    ids, dist = np.full((nq, beam), -1, np.int64), np.full((nq, beam), np.inf, vectors.dtype)
    closed = np.ones((nq, beam), bool)
    rows = np.arange(nq)
    ids[:, 0], closed[:, 0] = start, False
    dist[:, 0] = _distances(vectors, queries, start)
    mark[rows, start] = 0
    live = rows
    while len(live):
        waiting = np.where(closed[live], np.inf, dist[live])
        by = np.argsort(waiting, axis=1, kind="stable")[:, :expand]
        open_ = np.isfinite(np.take_along_axis(waiting, by, 1))
        has = open_[:, 0]
        live, by, open_ = live[has], by[has], open_[has]
        if not len(live):
            break
        r = np.repeat(live, by.shape[1])[open_.ravel()]
        c = by.ravel()[open_.ravel()]
        closed[r, c] = True
        near = lists[ids[r, c]]
        owner = np.repeat(r, near.shape[1])
        near = near.ravel()
        ok = near >= 0
        owner, near = owner[ok], near[ok]
        fresh = mark[owner, near] < 0
        owner, near = owner[fresh], near[fresh]
        mark[owner, near] = np.arange(len(near), dtype=np.int32)
        first = mark[owner, near] == np.arange(len(near))
        owner, near = owner[first], near[first]
        gap = _distances(vectors, queries[owner], near)
        good = gap < dist[owner, -1]
        owner, near, gap = owner[good], near[good], gap[good]
        if not len(owner):
            continue
        by = np.argsort(owner, kind="stable")
        owner, near, gap = owner[by], near[by], gap[by]
        who, first, counts = np.unique(owner, return_index=True, return_counts=True)
        column = np.arange(len(owner)) - np.repeat(first, counts)
        row = np.repeat(np.arange(len(who)), counts)
        add_ids = np.full((len(who), counts.max()), -1, np.int64)
        add_gap = np.full(add_ids.shape, np.inf, vectors.dtype)
        add_ids[row, column], add_gap[row, column] = near, gap
        all_ids, all_gap = np.hstack([ids[who], add_ids]), np.hstack([dist[who], add_gap])
        all_closed = np.hstack([closed[who], add_ids < 0])
        by = np.argsort(all_gap, axis=1, kind="stable")[:, :beam]
        ids[who], dist[who] = np.take_along_axis(all_ids, by, 1), np.take_along_axis(all_gap, by, 1)
        closed[who] = np.take_along_axis(all_closed, by, 1)
    return ids, dist


def _descend(vectors, above, queries):
    """Position among the nodes of the lowest level in ``above`` of the nearest one that a greedy walk finds."""
    nodes, levels = above
    at = np.full(len(queries), nodes[-1][0], np.int64)
    for members, lists in zip(reversed(nodes), reversed(levels)):
        place = np.full(len(vectors), -1, np.int64)
        place[members] = np.arange(len(members))
        own = np.where(lists >= 0, place[lists], -1).astype(np.int32)
        found, _ = beam_search(vectors[members], own, queries, place[at], 4, expand=1)
        at = members[found[:, 0]]
    return place[at]


def search(graph: Graph, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """``(numbers, distances)`` of the nodes nearest to each query that beams of this width find, nearest first."""
    beam = min(beam, len(graph.vectors))
    ids = np.full((len(queries), beam), -1, np.int64)
    dist = np.full((len(queries), beam), np.inf, graph.vectors.dtype)
    if not len(graph.vectors):
        return ids, dist
    step = max(1, min(QUERIES_AT_ONCE, (1 << 22) // len(graph.vectors) + 1))
    for lo in range(0, len(queries), step):
        some = queries[lo:lo + step]
        if len(graph.nodes) > 1:
            start = graph.nodes[1][_descend(graph.vectors, (graph.nodes[1:], graph.levels[1:]), some)]
        else:
            start = np.zeros(len(some), np.int64)
        ids[lo:lo + step], dist[lo:lo + step] = beam_search(graph.vectors, graph.levels[0], some, start, beam)
    return ids, dist

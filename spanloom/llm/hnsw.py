"""Hierarchical navigable small-world graph of one shard, in flat arrays.

Nodes are numbered by falling level, so layer ``l`` holds the nodes ``0 .. size_l - 1`` and is one matrix of neighbour
numbers (-1: none). Nodes are inserted in batches: the batch searches the graph built so far from the top layer down,
compares its members with each other, links every node to a diverse choice of what was found and trims the lists that
grow too long. Searches walk many queries at once.

The largest inner product becomes the least distance by one more component, ``sqrt(m^2 - |x|^2)`` with ``m`` the
longest vector, which a query has as 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LINKS, BUILD_WIDTH, BATCH = 16, 64, 256
SMALL = 64
AT_ONCE = 4


def augmented(x: np.ndarray) -> np.ndarray:
    """Unit scale vectors with the component that makes all of them equally long."""
    x = x.astype(np.float64)
    x = x / (np.abs(x).max() or 1.0)
    norms = (x * x).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0))[:, None]], 1).astype(np.float32)


@dataclass
class Graph:
    """``points`` are augmented vectors; ``layers[l]`` is the neighbour matrix of layer ``l``."""

    points: np.ndarray
    layers: list[np.ndarray]

    def walk(self, layer: int, queries: np.ndarray, start: np.ndarray, width: int, among: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search in one layer: distances and numbers of ``width`` nodes for each query, nearest first."""
        points, links, n = self.points, self.layers[layer], len(queries)
        width = min(width, among)
        dist = np.full((n, width), np.inf, np.float32)
        node = np.full((n, width), -1, np.int64)
        open_ = np.zeros((n, width), bool)
        seen = np.zeros((n, among + 1), bool)
        seen[:, among] = True  # the place of neighbour -1
        new, live = start[:, :width], np.arange(n)
        while len(live):
            new = np.where(new < 0, among, new)
            first = np.sort(new, 1)
            order = np.argsort(new, 1, kind="stable")
            twice = np.zeros(new.shape, bool)
            np.put_along_axis(twice, order[:, 1:], first[:, 1:] == first[:, :-1], 1)
            row, col = np.nonzero(~seen[live[:, None], new] & ~twice)
            at = new[row, col]
            seen[live[row], at] = True
            far = np.full(new.shape, np.inf, np.float32)
            gap = points[at] - queries[live[row]]
            far[row, col] = np.einsum("nd,nd->n", gap, gap)
            all_d = np.concatenate([dist[live], far], 1)
            all_n = np.concatenate([node[live], new], 1)
            all_o = np.concatenate([open_[live], far < np.inf], 1)
            best = np.argpartition(all_d, width - 1, 1)[:, :width] if all_d.shape[1] > width else np.arange(width)[None].repeat(len(live), 0)
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_d, best, 1), 1, kind="stable"), 1)
            dist[live], node[live], open_[live] = (np.take_along_axis(a, best, 1) for a in (all_d, all_n, all_o))
            live = live[open_[live].any(1)]
            if not len(live):
                break
            # The nearest open nodes of each query are expanded together.
            pick = np.argsort(~open_[live], 1, kind="stable")[:, :AT_ONCE]
            is_open = np.take_along_axis(open_[live], pick, 1)
            chosen = np.where(is_open, np.take_along_axis(node[live], pick, 1), -1)
            open_[live[:, None], pick] = False
            new = np.where(chosen[:, :, None] < 0, -1, links[chosen]).reshape(len(live), -1)
        node[dist == np.inf] = -1
        return dist, node

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        """Numbers of ``width`` near nodes of each query (-1: none), nearest first."""
        if len(self.points) <= max(SMALL, width):
            gap = ((queries[:, None, :] - self.points[None]) ** 2).sum(2)
            return np.argsort(gap, 1, kind="stable")
        start = np.zeros((len(queries), 1), np.int64)
        for layer in range(len(self.layers) - 1, 0, -1):
            start = self.walk(layer, queries, start, AT_ONCE, len(self.layers[layer]))[1]
        return self.walk(0, queries, start, width, len(self.points))[1]


def _diverse(points: np.ndarray, dist: np.ndarray, node: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's candidates (nearest first): those nearer to the row than to a chosen one, then the nearest others."""
    if node.shape[1] <= most:
        return np.where(np.isfinite(dist), node, -1)
    p = points[node]
    norms = np.einsum("rcd,rcd->rc", p, p)
    between = norms[:, :, None] + norms[:, None, :] - 2 * (p @ p.transpose(0, 2, 1))
    nearest = np.full(dist.shape, np.inf, np.float32)  # from each candidate to the chosen ones
    chosen, count = np.zeros(dist.shape, bool), np.zeros(len(dist), np.int64)
    for c in range(node.shape[1]):
        take = (dist[:, c] < nearest[:, c]) & (count < most) & np.isfinite(dist[:, c])
        chosen[:, c] = take
        count += take
        nearest = np.where(take[:, None], np.minimum(nearest, between[:, c]), nearest)
    order = np.argsort(~chosen, 1, kind="stable")[:, :most]
    return np.where(np.isfinite(np.take_along_axis(dist, order, 1)), np.take_along_axis(node, order, 1), -1)


def _link(points: np.ndarray, links: np.ndarray, owner: np.ndarray, other: np.ndarray) -> None:
    """Add ``other`` to the lists of ``owner``; a list that is full keeps a diverse choice."""
    order = np.argsort(owner, kind="stable")
    owner, other = owner[order], other[order]
    who, first, count = np.unique(owner, return_index=True, return_counts=True)
    place = np.arange(len(owner)) - np.repeat(first, count)
    wide = np.full((len(who), links.shape[1] + count.max()), -1, np.int64)
    wide[:, :links.shape[1]] = links[who]
    wide[np.repeat(np.arange(len(who)), count), links.shape[1] + place] = other
    fits = (wide >= 0).sum(1) <= links.shape[1]
    for mask in (fits, ~fits):
        part = wide[mask]
        for at in range(0, len(part), BATCH):
            some, them = part[at:at + BATCH], who[mask][at:at + BATCH]
            if mask is fits:
                links[them] = np.take_along_axis(some, np.argsort(some < 0, 1, kind="stable"), 1)[:, :links.shape[1]]
                continue
            gap = ((points[np.maximum(some, 0)] - points[them][:, None]) ** 2).sum(2)
            gap[some < 0] = np.inf
            near = np.argsort(gap, 1, kind="stable")[:, :2 * links.shape[1]]
            links[them] = _diverse(points, np.take_along_axis(gap, near, 1), np.take_along_axis(some, near, 1), links.shape[1])


def _join_up(graph: Graph, layer: int) -> None:
    """Link nodes that cannot be reached from node 0 to the nearest node that can, in a column kept free for it."""
    links = graph.layers[layer]
    while True:
        reached = np.zeros(len(links), bool)
        edge = np.array([0])
        while len(edge):
            reached[edge] = True
            edge = np.unique(links[edge])
            edge = edge[edge >= 0]
            edge = edge[~reached[edge]]
        if reached.all():
            return
        inside, outside = np.flatnonzero(reached & (links[:, -1] < 0)), np.flatnonzero(~reached)[:BATCH]
        gap = ((graph.points[outside][:, None, :8] - graph.points[inside][None, :, :8]) ** 2).sum(2) if len(inside) < 4096 else -(graph.points[outside] @ graph.points[inside].T)
        for o, i in zip(outside, inside[np.argmin(gap, 1)]):
            if links[i, -1] < 0:
                links[i, -1] = o


def levels(marks: np.ndarray) -> np.ndarray:
    """Level of each node from a 64-bit mark: one node in ``LINKS`` goes up a level."""
    u = (marks.astype(np.uint64).astype(np.float64) + 1) / 2.0 ** 64
    return np.floor(-np.log(np.minimum(u, 1.0)) / np.log(LINKS)).astype(np.int64)


def build(points: np.ndarray, level: np.ndarray) -> Graph:
    """Graph of augmented ``points`` whose ``level`` falls; both in node order."""
    n, top = len(points), int(level[0]) if len(points) else 0
    sizes = [int((level >= l).sum()) for l in range(top + 1)]
    # The last column is for links that join parts.
    graph = Graph(points, [np.full((s, (2 if l == 0 else 1) * LINKS + 1), -1, np.int64) for l, s in enumerate(sizes)])
    if n <= SMALL:
        return graph
    done = 0
    while done < n:
        now = int(level[done])
        end = min(done + min(BATCH, max(32, done)), sizes[now])
        batch = np.arange(done, end)
        mine = points[batch]
        inner = ((mine[:, None, :] - mine[None]) ** 2).sum(2)
        np.fill_diagonal(inner, np.inf)
        mates = np.argsort(inner, 1, kind="stable")[:, :LINKS]
        start = np.zeros((len(batch), 1), np.int64)
        for layer in range(top, -1, -1):
            width = BUILD_WIDTH if layer <= now else AT_ONCE
            if done:
                dist, node = graph.walk(layer, mine, start, width, min(done, sizes[layer]))
                start = node
            if layer > now:
                continue
            far, who = np.take_along_axis(inner, mates, 1), batch[mates]
            far = np.where(np.isfinite(far), far, np.inf)
            if done:
                far, who = np.concatenate([dist, far], 1), np.concatenate([node, who], 1)
            order = np.argsort(far, 1, kind="stable")
            kept = _diverse(points, np.take_along_axis(far, order, 1), np.take_along_axis(who, order, 1), LINKS)
            links = graph.layers[layer][:, :-1]
            links[batch, :kept.shape[1]] = kept
            row, col = np.nonzero(kept >= 0)
            if len(row):
                _link(points, links, kept[row, col], batch[row])
        done = end
    for layer in range(top + 1):
        _join_up(graph, layer)
    return graph

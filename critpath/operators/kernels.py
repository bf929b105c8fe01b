"""Exact in-memory kernels for graphs or partitions of bounded size."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np


FAR = np.iinfo(np.int64).max // 4


class Adjacency:
    """Neighbours of each vertex under one criterion, in compressed rows."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray):
        ids = np.union1d(src, dst)
        a, b = np.searchsorted(ids, src).astype(np.int32), np.searchsorted(ids, dst).astype(np.int32)
        self.ids = ids.astype(np.int64)
        small = not len(w) or w.max() < 1 << 31  # half the bytes
        w = np.asarray(w, np.int32 if small else np.int64)
        if (a[1:] < a[:-1]).any():
            order = np.argsort(a, kind="stable")
            a, b, w = a[order], b[order], w[order]
        self.to, self.w = b, w
        self.start = np.searchsorted(a, np.arange(len(self.ids) + 1, dtype=np.int32))
        #: Labels this close to the nearest are expanded together.
        self.width = max(1, int(w.mean())) if len(w) else 1

    def places(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of these vertices, and which of them exist."""
        at = np.minimum(np.searchsorted(self.ids, v), max(0, len(self.ids) - 1))
        return at, self.ids[at] == v if len(self.ids) else np.zeros(len(v), bool)

    def distances(self, n: int, search: np.ndarray, place: np.ndarray, d: np.ndarray, goal: np.ndarray | None = None, width: int | None = None, enough: int | None = None, ends: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Least distances (a row for each of n searches; FAR: not reached) from seeds (search, place, d).

        Of the labels that changed, those in the nearest bucket of `width` are expanded all at once, until none is left; so
        on a graph of many hops a label is seldom expanded before it is final. With `goal`, a place for each search, labels as far as
        that of the goal aren't expanded; final are the goal's distance and those less than it. With `enough` a search ends once the vertices
        nearer than its open labels have that many edges, and gives only their distances. With `ends`, rows (search, place, d) from which it is as far as d
        to a search's goal, labels as far as the goal aren't expanded; final are those that give its distance.
        """
        size, width = len(self.ids), width or self.width
        rounds, look, limit = 0, 1, np.full(n, FAR)
        best = np.full(n * size, FAR)
        np.minimum.at(best, search * size + place, d)
        front = np.unique(search * size + place)
        while len(front):
            own = best[front]
            rounds += 1
            if enough is not None and rounds >= look:
                look = rounds + rounds // 20 + 500  # a look takes as long as some dozens of rounds
                degree, low = np.diff(self.start), own.min()
                for k in np.unique(front // size):
                    if degree[best[k * size : (k + 1) * size] < low].sum() >= enough:
                        limit[k] = low
                front = front[limit[front // size] == FAR]
                own = best[front]
                if not len(front):
                    break
            near = own < (own.min() // width + 1) * width
            later, front, own = front[~near], front[near], own[near]
            v = front % size
            count = self.start[v + 1] - self.start[v]
            edge = np.repeat(self.start[v] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            reach, to = np.repeat(own, count) + self.w[edge], np.repeat(front - v, count) + self.to[edge]
            better = reach < best[to]
            if goal is not None:
                better &= reach < np.repeat(best[front - v + goal[front // size]], count)
            if ends is not None:
                least = np.full(n, FAR)
                np.minimum.at(least, ends[0], best[ends[0] * size + ends[1]] + ends[2])
                better &= reach < np.repeat(least[front // size], count)
            reach, to = reach[better], to[better]
            np.minimum.at(best, to, reach)
            front = np.unique(np.concatenate([later, to]))
        best = best.reshape(n, size)
        if enough is not None:
            best[best >= limit[:, None]] = FAR
        return best

    def meeting(self, s: np.ndarray | int, t: np.ndarray | int, ds: np.ndarray | int = 0, dt: np.ndarray | int = 0, least: int = FAR) -> int:
        """Least distance between places s, at ds to begin with, and t, at dt, by a search from both; `least` if there is no shorter path."""
        best = np.full((2, len(self.ids)), FAR)
        np.minimum.at(best[0], s, ds)
        np.minimum.at(best[1], t, dt)
        fronts = [np.unique(s), np.unique(t)]
        if len(fronts[0]) and len(fronts[1]):
            least = min(least, int((best[0] + best[1])[fronts[0]].min()))
        while len(fronts[0]) or len(fronts[1]):
            side = 0 if len(fronts[1]) == 0 or 0 < len(fronts[0]) <= len(fronts[1]) else 1
            own, v = best[side], fronts[side]
            v = v[2 * own[v] <= least]  # an optimal path has labels up to its half from both ends
            near = own[v] < (own[v].min(initial=FAR) // self.width + 1) * self.width
            later, v = v[~near], v[near]
            count = self.start[v + 1] - self.start[v]
            edge = np.repeat(self.start[v] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            reach, to = np.repeat(own[v], count) + self.w[edge], self.to[edge]
            better = (reach < own[to]) & (reach <= least)
            reach, to = reach[better], to[better]
            np.minimum.at(own, to, reach)
            fronts[side] = np.unique(np.concatenate([later, to]))
            if len(to):
                least = min(least, int((best[0][to] + best[1][to]).min()))
        return least


def spanning_tree(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> list[tuple[int, int, int]]:
    """Edges (w, u, v) of the minimum spanning forest; equal weights in order of the smaller, then the larger end."""
    u, v = np.minimum(src, dst), np.maximum(src, dst)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    tree = []
    for i in np.lexsort((v, u, w)).tolist():
        a, b = root(int(u[i])), root(int(v[i]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            tree.append((int(w[i]), int(u[i]), int(v[i])))
    return tree


def prim(src: np.ndarray, dst: np.ndarray, w: np.ndarray, start: int | None = None) -> list[tuple[int, int, int]]:
    """Edges (from, to, w) of the spanning tree in the order in which it grows from `start` (else the least vertex).

    Next comes the lightest edge to a vertex outside; of equal ones that to the smallest vertex, then from the smallest. A graph
    that isn't connected is an error.
    """
    near: dict[int, list[tuple[int, int]]] = {}
    for a, b, x in zip(src.tolist(), dst.tolist(), w.tolist()):
        near.setdefault(a, []).append((x, b))
        near.setdefault(b, []).append((x, a))
    if not near:
        return []
    at = min(near) if start is None else start
    inside, queue, tree = {at}, [(x, b, at) for x, b in near[at]], []
    heapq.heapify(queue)
    while queue:
        x, b, a = heapq.heappop(queue)
        if b not in inside:
            inside.add(b)
            tree.append((a, b, x))
            for y, c in near[b]:
                if c not in inside:
                    heapq.heappush(queue, (y, c, b))
    if len(inside) < len(near):
        raise ValueError("the graph is not connected")
    return tree


def preorder(edges: Iterable[tuple[int, int]]) -> list[int]:
    """Vertices of a forest in depth-first order: roots and children by ascending id."""
    near: dict[int, list[int]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out, seen = [], set()
    for r in sorted(near):
        stack = [r]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                out.append(x)
                stack += sorted((y for y in near[x] if y not in seen), reverse=True)
    return out

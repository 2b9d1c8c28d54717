"""A cover tree over unit vectors, and the dual traversal that finds all close pairs of two trees.

The root covers all points; the children of a node are a net of its points
(farthest point first) whose covering radius is at most half of the node's, and
the node's own centre is the first of them.  Two nodes whose centres are
farther apart than both radii and the wanted distance hold no pair; two that
are nearer by both radii are linked point by point without a look at them.
"""

from __future__ import annotations

import numpy as np

BUCKET = 32  # nodes of at most so many points are not split
SLACK = 1e-7  # more than the error of a distance taken from a dot product


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


class CoverTree:
    """``order``: points so that those of a node are neighbours; ``nodes``: centre, first and last place, first and last child."""

    def __init__(self, order: np.ndarray, nodes: np.ndarray, radius: np.ndarray):
        self.order, self.nodes, self.radius = order, nodes, radius

    @classmethod
    def build(cls, points: np.ndarray) -> CoverTree:
        n = len(points)
        order = np.arange(n)
        nodes: list[list[int]] = [[0, 0, n, 0, 0]]
        apart = _distance(points @ points[0]) if n else np.empty(0)
        radius = [float(apart.max()) if n else 0.0]
        todo = [(0, apart)]
        while todo:
            node, apart = todo.pop()
            _, first, last, _, _ = nodes[node]
            if last - first <= BUCKET or radius[node] <= SLACK:
                continue
            mine = order[first:last]
            which = np.zeros(len(mine), dtype=np.int64)
            centres = [nodes[node][0]]
            while apart.max() > radius[node] / 2:
                far = mine[int(apart.argmax())]
                to = _distance(points[mine] @ points[far])
                to[mine == far] = 0.0
                nearer = to < apart
                apart = np.where(nearer, to, apart)
                which[nearer] = len(centres)
                centres.append(int(far))
            by = np.argsort(which, kind="stable")
            order[first:last] = mine[by]
            apart, sizes = apart[by], np.bincount(which, minlength=len(centres))
            nodes[node][3:] = [len(nodes), len(nodes) + len(centres)]
            at = 0
            for centre, size in zip(centres, sizes.tolist()):
                part = apart[at : at + size]
                todo.append((len(nodes), part))
                nodes.append([centre, first + at, first + at + size, 0, 0])
                radius.append(float(part.max()) if size else 0.0)
                at += size
        return cls(order, np.array(nodes, dtype=np.int64), np.array(radius))

    def parts(self, node: int, point: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What a node falls into: centres, radii, nodes (-1: a single point) and places."""
        if node < 0:
            return np.array([self.order[point]]), np.zeros(1), np.array([-1]), np.array([point])
        _, first, last, child, end = self.nodes[node]
        if end > child:
            kids = np.arange(child, end)
            kids = kids[self.nodes[kids, 2] > self.nodes[kids, 1]]
            single = self.nodes[kids, 2] - self.nodes[kids, 1] == 1
            return self.nodes[kids, 0], self.radius[kids], np.where(single, -1, kids), self.nodes[kids, 1]
        places = np.arange(first, last)
        return self.order[places], np.zeros(len(places)), np.full(len(places), -1), places

    def range_of(self, node: int, place: int) -> tuple[int, int]:
        return (place, place + 1) if node < 0 else (int(self.nodes[node, 1]), int(self.nodes[node, 2]))


class Links:
    """Links found so far: per point of both sides how much weight it is linked to, and edges that connect the same points."""

    def __init__(self, a: CoverTree, b: CoverTree, weight_a: np.ndarray, weight_b: np.ndarray):
        self.sums_a = np.concatenate([[0], np.cumsum(weight_a[a.order])])
        self.sums_b = np.concatenate([[0], np.cumsum(weight_b[b.order])])
        self.weight_a, self.weight_b = weight_a, weight_b
        self.a, self.b = a, b
        self.range_a = np.zeros(len(a.order) + 1, dtype=np.int64)
        self.range_b = np.zeros(len(b.order) + 1, dtype=np.int64)
        self.count_a = np.zeros(len(a.order), dtype=np.int64)
        self.count_b = np.zeros(len(b.order), dtype=np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def pairs(self, x: np.ndarray, y: np.ndarray) -> None:
        """Single points by their numbers."""
        np.add.at(self.count_a, x, self.weight_b[y])
        np.add.at(self.count_b, y, self.weight_a[x])
        self.edges.append((x, y))

    def all_of(self, x: tuple[int, int], y: tuple[int, int], same: bool) -> None:
        """Every point in range ``x`` with every point in ``y``; with each other point of the range if they are the same."""
        self.range_a[x[0]] += self.sums_b[y[1]] - self.sums_b[y[0]]
        self.range_a[x[1]] -= self.sums_b[y[1]] - self.sums_b[y[0]]
        mine, other = self.a.order[x[0] : x[1]], self.b.order[y[0] : y[1]]
        if same:
            np.add.at(self.count_a, mine, -self.weight_a[mine])
        else:
            self.range_b[y[0]] += self.sums_a[x[1]] - self.sums_a[x[0]]
            self.range_b[y[1]] -= self.sums_a[x[1]] - self.sums_a[x[0]]
        self.edges.append((mine, np.full(len(mine), other[0])))
        self.edges.append((np.full(len(other), mine[0]), other))

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        left, right = self.count_a.copy(), self.count_b.copy()
        left[self.a.order] += np.cumsum(self.range_a[:-1])
        right[self.b.order] += np.cumsum(self.range_b[:-1])
        return left, right


def dual_links(a: CoverTree, b: CoverTree, x: np.ndarray, y: np.ndarray, weight_a: np.ndarray, weight_b: np.ndarray, cosine: float, same: bool) -> Links:
    """All pairs of a point of ``a`` and one of ``b`` with at least this cosine; each once if the trees are the same."""
    reach = float(_distance(np.array(cosine)))
    found = Links(a, b, weight_a, weight_b)
    todo = [(0, 0, 0, 0, same)] if len(x) and len(y) else []
    while todo:
        na, pa_, nb, pb_, twin = todo.pop()
        ca, ra, ka, sa = a.parts(na, pa_)
        cb, rb, kb, sb = (ca, ra, ka, sa) if twin else b.parts(nb, pb_)
        cos = x[ca] @ y[cb].T
        apart = _distance(cos)
        radii = ra[:, None] + rb[None, :]
        open_ = apart - radii <= reach + SLACK
        if twin:
            open_ &= np.triu(np.ones(open_.shape, dtype=bool), 1)
        single = (ka < 0)[:, None] & (kb < 0)[None, :]
        i, j = np.nonzero(open_ & single & (cos >= cosine))
        if len(i):
            found.pairs(ca[i], cb[j])
        inside = open_ & ~single & (apart + radii <= reach - SLACK)
        for i, j in zip(*np.nonzero(inside)):
            found.all_of(a.range_of(int(ka[i]), int(sa[i])), b.range_of(int(kb[j]), int(sb[j])), False)
        for i, j in zip(*np.nonzero(open_ & ~single & ~inside)):
            todo.append((int(ka[i]), int(sa[i]), int(kb[j]), int(sb[j]), False))
        if twin:
            for i in np.flatnonzero(ka >= 0).tolist():
                if 2 * ra[i] <= reach - SLACK:
                    span = a.range_of(int(ka[i]), int(sa[i]))
                    found.all_of(span, span, True)
                else:
                    todo.append((int(ka[i]), int(sa[i]), int(ka[i]), int(sa[i]), True))
    return found


def spanning(n: int, edges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` points the smallest point that the edges lead to."""
    low = np.arange(n)
    if not edges:
        return low
    x, y = (np.concatenate([e[k] for e in edges]) for k in (0, 1))
    while True:
        before = low.copy()
        least = np.minimum(low[x], low[y])
        np.minimum.at(low, x, least)
        np.minimum.at(low, y, least)
        low = low[low]
        if (low == before).all():
            return low

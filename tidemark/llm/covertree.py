"""A cover tree over unit vectors and its dual traversal for all pairs above a cosine."""

import math

import numpy as np

#: Bounds are trusted by this much less; single pairs are decided by their cosine itself.
SLACK = 1e-9


class CoverTree:
    """Nested nets with halving radii. A node is a centre, its true covering radius and a run of the ordered points.

    The children of a node are a net of its points at half its level's radius, found greedily, the node's own centre
    first; so every point below a child lies within that half of the child's centre. Leaves are single points.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self.order = np.zeros(len(x), dtype=np.int64)
        if len(x):
            self._build()
        self.rows = [x[[self.centre[c] for c in kids]] if kids else x[[self.centre[i]]] for i, kids in enumerate(self.children)]
        self.radii = np.array(self.radius)

    def _node(self, centre: int, radius: float, lo: int, hi: int) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.span.append((lo, hi))
        self.children.append([])
        return len(self.centre) - 1

    def _build(self):
        members = np.arange(len(self.x))
        d = self._far(0, members)
        todo = [(self._node(0, float(d.max()), 0, len(members)), members, d, 2.0)]
        while todo:
            node, members, d, level = todo.pop()
            lo = self.span[node][0]
            if len(members) == 1:
                self.order[lo] = members[0]
                continue
            level = min(level, max(self.radius[node], 1e-12))
            half = level / 2
            if half < 1e-9 or len(members) <= 4:
                groups = [(np.array([m]), np.zeros(1)) for m in members]
            else:
                groups, left, to = [], members, d
                while len(left):
                    near = to <= half
                    groups.append((left[near], to[near]))
                    left = left[~near]
                    if len(left):
                        to = self._far(left[0], left)
            for own, far in groups:
                centre = int(own[int(np.argmin(far))]) if len(own) else 0
                child = self._node(centre, float(far.max()), lo, lo + len(own))
                self.children[node].append(child)
                todo.append((child, own, far, half))
                lo += len(own)

    def _far(self, centre: int, members: np.ndarray) -> np.ndarray:
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.x[members] @ self.x[centre])))
        d[members == centre] = 0.0
        return d


class _Links:
    """Counts by ranges, and a forest of what is linked."""

    def __init__(self, a: CoverTree, b: CoverTree, wa: np.ndarray, wb: np.ndarray, same: bool):
        self.a, self.b, self.same = a, b, same
        self.sum_a = np.concatenate([[0], np.cumsum(wa[a.order])])
        self.sum_b = np.concatenate([[0], np.cumsum(wb[b.order])])
        self.add_a, self.add_b = np.zeros(len(wa) + 1, dtype=np.int64), np.zeros(len(wb) + 1, dtype=np.int64)
        self.up = list(range(len(wa) + (0 if same else len(wb))))
        self.edges: list[tuple[int, int]] = []
        self.shift = 0 if same else len(wa)
        self.whole: set[tuple[int, int]] = set()

    def _root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def _join(self, i: int, j: int):
        i, j = self._root(i), self._root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
            self.edges.append((i, j))

    def _gather(self, tree: CoverTree, node: int, shift: int) -> int:
        """Join all points of a node, once, and return one of them."""
        lo, hi = tree.span[node]
        first = int(tree.order[lo]) + shift
        if hi - lo > 1 and (node, shift) not in self.whole:
            self.whole.add((node, shift))
            for k in (tree.order[lo + 1 : hi] + shift).tolist():
                self._join(first, k)
        return first

    def itself(self, node: int):
        """Every two points of a node of the tree a."""
        lo, hi = self.a.span[node]
        self.add_a[lo] += self.sum_a[hi] - self.sum_a[lo]
        self.add_a[hi] -= self.sum_a[hi] - self.sum_a[lo]
        self._gather(self.a, node, 0)

    def pairs(self, ci: np.ndarray, cj: np.ndarray, hit: np.ndarray):
        """Every point of node ci[k] of a with every one of node cj[m] of b, where hit[k, m] is true."""
        rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        if not len(rows):
            return
        hit, ci, cj = hit[np.ix_(rows, cols)], ci[rows], cj[cols]
        sa, sb = np.array([self.a.span[c] for c in ci.tolist()]), np.array([self.b.span[c] for c in cj.tolist()])
        wa, wb = self.sum_a[sa[:, 1]] - self.sum_a[sa[:, 0]], self.sum_b[sb[:, 1]] - self.sum_b[sb[:, 0]]
        add_b = self.add_a if self.same else self.add_b
        ga, gb = hit @ wb, wa @ hit
        np.add.at(self.add_a, sa[:, 0], ga)
        np.add.at(self.add_a, sa[:, 1], -ga)
        np.add.at(add_b, sb[:, 0], gb)
        np.add.at(add_b, sb[:, 1], -gb)
        # connected nodes take the least number among them, back and forth until nothing changes
        label = np.arange(len(rows))
        while True:
            cols_label = np.where(hit, label[:, None], len(rows)).min(axis=0)
            new = np.where(hit, cols_label[None, :], len(rows)).min(axis=1)
            if (new == label).all():
                break
            label = new
        pa = [self._gather(self.a, c, 0) for c in ci.tolist()]
        pb = [self._gather(self.b, c, self.shift) for c in cj.tolist()]
        for k, l in enumerate(label.tolist()):
            self._join(pa[l], pa[k])
        for m, l in enumerate(cols_label.tolist()):
            self._join(pa[l], pb[m])


def linked(xa: np.ndarray, wa: np.ndarray, xb: np.ndarray | None, wb: np.ndarray | None, cosine: float):
    """Links of at least `cosine` among the unit vectors xa, or between xa and xb.

    Returns for each of xa (and of xb) the summed weight of its links, itself left out, and edges that connect what is
    linked; in edges the rows of xb follow those of xa.
    """
    same = xb is None
    a = CoverTree(xa)
    b = a if same else CoverTree(xb)
    wb = wa if same else wb
    out = _Links(a, b, wa, wb, same)
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    todo = [(0, 0)] if len(xa) and len(a.centre) and len(b.centre) else []
    while todo:
        i, j = todo.pop()
        if same and i == j and 2 * a.radius[i] + SLACK <= reach:
            if a.span[i][1] - a.span[i][0] > 1:
                out.itself(i)
            continue
        ci, cj = np.array(a.children[i] or [i]), np.array(b.children[j] or [j])
        cos = a.rows[i] @ b.rows[j].T
        room = a.radii[ci][:, None] + b.radii[cj][None, :]
        far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))
        single = room == 0.0
        hit = np.where(single, cos >= cosine, far + room + SLACK <= reach)
        open_ = ~hit & ~single & (far - room - SLACK <= reach)
        if same and i == j:
            keep = np.triu(np.ones(cos.shape, dtype=bool), 1)
            hit, open_ = hit & keep, open_ & keep
            todo += [(c, c) for c in ci.tolist() if a.span[c][1] - a.span[c][0] > 1]
        out.pairs(ci, cj, hit)
        todo += [(int(ci[k]), int(cj[m])) for k, m in zip(*np.nonzero(open_), strict=True)]
    na = np.zeros(len(wa), dtype=np.int64)
    na[a.order] = np.cumsum(out.add_a)[: len(wa)]
    if same:
        # within an accepted node a point counted itself
        return na - _own(out, a, wa, reach), None, out.edges
    nb = np.zeros(len(wb), dtype=np.int64)
    nb[b.order] = np.cumsum(out.add_b)[: len(wb)]
    return na, nb, out.edges


def _own(out: _Links, a: CoverTree, wa: np.ndarray, reach: float) -> np.ndarray:
    """What each point added of itself: once if an accepted node holds it."""
    own = np.zeros(len(wa) + 1, dtype=np.int64)
    todo = [0] if len(a.centre) else []
    while todo:
        i = todo.pop()
        lo, hi = a.span[i]
        if 2 * a.radius[i] + SLACK <= reach:
            if hi - lo > 1:
                own[lo] += 1
                own[hi] -= 1
        else:
            todo += a.children[i]
    res = np.zeros(len(wa), dtype=np.int64)
    res[a.order] = (np.cumsum(own)[: len(wa)] > 0) * wa[a.order]
    return res

"""A cover tree over vectors of whole numbers, for exact searches by inner product.

A coordinate is added to every vector so that all have the norm of the longest; a query gets 0
there, so an inner product is the length of both times the cosine of their angle. A node covers
its vectors by an angle around one of them. With the angle of query and centre that bounds the
inner products below it from both sides, level by level.
"""

from __future__ import annotations

import io
from typing import NamedTuple

import numpy as np

#: Below any score; and what bounds are loosened by, relative to the largest possible score.
NONE, SLACK = -(1 << 62), 1e-7
#: Centres tried at a node and scale; the fewest vectors that are worth a child of their own.
FAN, CHILD = 64, 8


class Tree(NamedTuple):
    """Vectors in an order in which every node's stand together; nodes by level, a parent before its children."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    center: np.ndarray
    angle: np.ndarray
    start: np.ndarray
    end: np.ndarray
    parent: np.ndarray
    leaf: np.ndarray


def augmented(vectors: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that lengthens them to ``top``, as doubles of length 1."""
    v = vectors.astype(np.float64)
    more = np.sqrt(np.maximum(0.0, top * top - (v * v).sum(1)))
    return np.column_stack([v, more]) / (top or 1.0)


def _angles(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(points @ center, -1.0, 1.0))


def build(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, top: float, leaf: int) -> Tree:
    """Level by level: within half of a node's angle of a new centre, vectors become its child.

    Centres are taken in turn from what no child covers. Children of fewer than CHILD vectors
    and what FAN centres leave go to one more child around the node's own centre. A node is a
    leaf once it has ``leaf`` vectors, or all are equal, or a scale parts nothing; scales
    halve, so this ends.
    """
    points = augmented(vectors, top)
    root = int(np.argmax(points @ points.mean(0)))
    level = [(root, np.arange(len(ids)), -1, np.pi)]
    nodes: list[tuple[int, float, int, int, bool]] = []  # centre, angle, parent, members' place in `kept`, leaf
    kept: list[np.ndarray] = []
    while level:
        below = []
        for center, members, parent, scale in level:
            angle = float(_angles(points[members], points[center]).max())
            me, parts = len(nodes), None
            scale = min(scale, angle) / 2
            if len(members) > leaf and scale > 1e-7:
                parts = _parted(points, members, center, scale)
            nodes.append((center, angle, parent, len(kept), parts is None))
            kept.append(members)
            below += [(c, m, me, scale) for c, m in parts or []]
        level = below
    # leaves in an order that keeps every node's vectors together
    children: dict[int, list[int]] = {}
    for k, n in enumerate(nodes):
        children.setdefault(n[2], []).append(k)
    start, end, place, stack = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), [], [(0, False)]
    at = 0
    while stack:
        k, done = stack.pop()
        if done:
            end[k] = at
        elif nodes[k][4]:
            m = kept[k]
            place.append(m[np.argsort(ids[m], kind="stable")])
            start[k], at = at, at + len(m)
            end[k] = at
        else:
            start[k] = at
            stack.append((k, True))
            stack += [(c, False) for c in reversed(children[k])]
    order = np.concatenate(place)
    center = np.array([n[0] for n in nodes])
    return Tree(ids[order], labels[order], vectors[order], vectors[center], np.array([n[1] for n in nodes]), start, end, np.array([n[2] for n in nodes]), np.array([n[4] for n in nodes]))


def _parted(points: np.ndarray, members: np.ndarray, center: int, scale: float) -> list[tuple[int, np.ndarray]] | None:
    """(centre, members) of the children, or None if none stands out."""
    reach, left, out, pick = np.cos(scale), members, [], center
    for t in range(FAN):
        near = points[left] @ points[pick] >= reach
        near[left == pick] = True
        if near.sum() >= CHILD:
            out.append((pick, left[near]))
            left = left[~near]
        if not len(left):
            break
        pick = int(left[(t + 1) * 2_654_435_761 % len(left)])
    if not out:
        return None
    return [*out, (center, left)] if len(left) else out


def packed(tree: Tree) -> bytes:
    """The tree as bytes; vectors in the narrowest integers that hold them."""
    f = io.BytesIO()
    widest = max(int(np.abs(tree.vectors).max(initial=0)), 1)
    kind = next(k for k in (np.int16, np.int32, np.int64) if widest <= np.iinfo(k).max)
    np.savez(f, **tree._replace(vectors=tree.vectors.astype(kind), center=tree.center.astype(kind))._asdict())
    return f.getvalue()


def unpacked(raw: bytes) -> Tree:
    with np.load(io.BytesIO(raw)) as z:
        return Tree(**{c: z[c] for c in Tree._fields})


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, exactly, in 64-bit integers."""
    x, y = np.abs(a).max(initial=0).astype(float), np.abs(b).max(initial=0).astype(float)
    if x * y * max(1, a.shape[1]) < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(anchors: np.ndarray, centers: np.ndarray, angle: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score of every anchor with anything that a node covers, a little loosened."""
    size = np.sqrt((anchors.astype(np.float64) ** 2).sum(1))[:, None] * top
    there = np.divide(scores(anchors, centers), size, out=np.zeros((len(anchors), len(centers))), where=size > 0)
    theta = np.arccos(np.clip(there, -1.0, 1.0))
    slack = SLACK * size + 1.0
    return size * np.cos(np.minimum(np.pi, theta + angle)) - slack, size * np.cos(np.maximum(0.0, theta - angle)) + slack


class Best:
    """For every query the first k of what was offered: higher scores first, then smaller ids.

    A query belongs to an anchor, wants scores from ``low`` to ``high``, and rows of the
    anchor's label or of other labels. ``floor`` is the least score that may still count.
    """

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> None:
        self.anchor, self.floor, self.high, self.k, self.same = anchor, low.copy(), high, k, same
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def wanted(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which queries a node may serve, from its bounds by anchor and node."""
        a = self.anchor
        return (most[a] >= self.floor[:, None]) & (least[a] <= self.high[:, None])

    def offer(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, s, i = np.append(self.query, query), np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < self.k
        self.query, self.score, self.id = q[keep], s[keep], i[keep]
        n = np.bincount(self.query, minlength=len(self.anchor))
        full = np.flatnonzero(n == self.k)
        last = np.cumsum(n)[full] - 1
        self.floor[full] = np.maximum(self.floor[full], self.score[last])

    def look(self, queries: np.ndarray, anchors: np.ndarray, labels: np.ndarray, own: np.ndarray, tree: Tree, lo: int, hi: int) -> None:
        """Verify the vectors [lo, hi) of a tree, which stand by id, for these queries."""
        rows, at = np.unique(self.anchor[queries], return_inverse=True)
        found = scores(anchors[rows], tree.vectors[lo:hi])[at]
        a = self.anchor[queries]
        fits = (tree.labels[lo:hi] == labels[a][:, None]) == self.same
        if self.same:
            fits &= tree.ids[lo:hi] != own[a][:, None]
        fits &= (found >= self.floor[queries][:, None]) & (found <= self.high[queries][:, None])
        if fits.sum() > 8 * self.k * len(queries):  # the first k of each query are enough
            ranked = np.argsort(np.where(fits, -found, 1 << 62), axis=1, kind="stable")[:, : self.k]
            q, c = np.repeat(np.arange(len(queries)), ranked.shape[1]), ranked.ravel()
            ok = fits[q, c]
            q, c = q[ok], c[ok]
        else:
            q, c = np.nonzero(fits)
        if len(q):
            self.offer(queries[q], found[q, c], tree.ids[lo:hi][c])


def search(tree: Tree, best: Best, queries: np.ndarray, anchors: np.ndarray, labels: np.ndarray, own: np.ndarray, top: float) -> int:
    """Go down a tree for these queries, then through its leaves from the most promising on; returns the vectors verified."""
    active = {0: queries}
    leaves = []
    for k in range(len(tree.angle)):
        mine = active.pop(k, None)
        if mine is None or not len(mine):
            continue
        if tree.leaf[k]:
            leaves.append((k, mine))
            continue
        kids = np.flatnonzero(tree.parent == k)
        rows, at = np.unique(best.anchor[mine], return_inverse=True)
        least, most = bounds(anchors[rows], tree.center[kids], tree.angle[kids], top)
        ok = (most[at] >= best.floor[mine][:, None]) & (least[at] <= best.high[mine][:, None])
        for j, c in enumerate(kids.tolist()):
            active[c] = mine[ok[:, j]]
    seen, ranked = 0, []
    for k, mine in leaves:
        rows, at = np.unique(best.anchor[mine], return_inverse=True)
        most = bounds(anchors[rows], tree.center[k : k + 1], tree.angle[k : k + 1], top)[1][at, 0]
        ranked.append((-float(most.max()), k, mine, most))
    for _, k, mine, most in sorted(ranked, key=lambda x: x[:2]):
        mine = mine[most >= best.floor[mine]]
        if len(mine):
            lo, hi = int(tree.start[k]), int(tree.end[k])
            best.look(mine, anchors, labels, own, tree, lo, hi)
            seen += hi - lo
    return seen

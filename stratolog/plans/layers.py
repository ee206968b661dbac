"""Exact layer assignment.

Minimise  sum pull_ij |z_i - z_j|  +  sum push_ij max(0, m_ij - z_i + z_j)  over layers z in 1..K, pull over unordered and push over ordered pairs.
Each term is convex in a difference of two variables, so the whole is a minimum cut in a graph with one node per type and threshold (Ishikawa 2003,
Hochbaum 2001).  Weights are made integers first; then sums do not depend on order and the cut is exact.  Optimal layers are seldom unique, but they form
a lattice; the answer is its least element, the smallest source side of a minimum cut.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence

#: Scores are rounded to this fraction before they are summed.
SCALE = 10**9

Scores = Mapping[tuple[str, str], float]


def quantise(score: float) -> int:
    """Half away from zero, as SQL rounds."""
    return int(abs(score) * SCALE + 0.5) * (1 if score >= 0 else -1)


def _terms(types: Sequence[str], push: Scores, pull: Scores, alpha: float, beta: float, margin_scale: float):
    """(i, j, cost of the difference z_i - z_j) for each weighted pair, in integers.  Margins that are no whole numbers make SCALE the unit of all costs."""
    unit = SCALE if margin_scale else 1
    for a, i in enumerate(types):
        for j in types[a + 1 :]:
            if (w := quantise(alpha * pull.get((i, j), 0.0)) * unit) > 0:
                yield i, j, lambda d, w=w: w * abs(d)
    for i in types:
        for j in types:
            score = push.get((i, j), 0.0)
            if i != j and (w := quantise(beta * score)) > 0:
                margin = unit + (quantise(margin_scale * score) if margin_scale else 0)
                yield i, j, lambda d, w=w, m=margin: w * max(0, m - d * unit)


def objective(layers: Mapping[str, int], push: Scores, pull: Scores, alpha: float = 1.0, beta: float = 1.0, margin_scale: float = 0.0) -> int:
    types = sorted(layers)
    return sum(cost(layers[i] - layers[j]) for i, j, cost in _terms(types, push, pull, alpha, beta, margin_scale))


def report(layers: Mapping[str, int], push: Scores, pull: Scores, alpha: float = 1.0, beta: float = 1.0, margin_scale: float = 0.0) -> str:
    """A solution in words: what it costs, and the layer of each type.  The cut is exact, so every solution is optimal."""
    cost = objective(layers, push, pull, alpha, beta, margin_scale) / (SCALE * SCALE if margin_scale else SCALE)
    width = max(map(len, layers), default=0)
    return "\n".join(["status: optimal", f"objective: {cost:.9g}", *(f"{t.ljust(width)}  {layers[t]}" for t in sorted(layers))])


class _Network:
    """Maximum flow by shortest augmenting paths in layered graphs (Dinic)."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> None:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)

    def distances(self, s: int) -> list[int]:
        far = [-1] * len(self.out)
        far[s], queue = 0, deque([s])
        while queue:
            x = queue.popleft()
            for e in self.out[x]:
                if self.room[e] > 0 and far[self.to[e]] < 0:
                    far[self.to[e]] = far[x] + 1
                    queue.append(self.to[e])
        return far

    def saturate(self, s: int, t: int) -> list[int]:
        """Push all flow; the distances that are left tell the source side (-1: not reached)."""
        while (far := self.distances(s))[t] >= 0:
            turn = [0] * len(self.out)
            path: list[int] = []
            x = s
            while True:
                if x == t:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    x, path = s, []
                while turn[x] < len(self.out[x]):
                    e = self.out[x][turn[x]]
                    if self.room[e] > 0 and far[self.to[e]] == far[x] + 1:
                        break
                    turn[x] += 1
                else:
                    if x == s:
                        break
                    x = self.to[path.pop() ^ 1]
                    turn[x] += 1
                    continue
                path.append(e)
                x = self.to[e]
        return far


def solve(types: Sequence[str], push: Scores, pull: Scores, alpha: float = 1.0, beta: float = 1.0, margin_scale: float = 0.0, verbose: bool = False) -> dict[str, int]:
    """The least optimal layer of each type; ``verbose`` prints the report."""
    found = _least_cut(sorted(types), push, pull, alpha, beta, margin_scale)
    if verbose:
        print(report(found, push, pull, alpha, beta, margin_scale))
    return found


def _least_cut(types: list[str], push: Scores, pull: Scores, alpha: float, beta: float, margin_scale: float) -> dict[str, int]:
    k = len(types)
    if k < 2:
        return dict.fromkeys(types, 1)
    at = {t: n for n, t in enumerate(types)}
    node = lambda i, level: 2 + at[i] * (k - 1) + level - 1  # noqa: E731  level 1..k-1; on the source side if z_i > level
    network = _Network(2 + k * (k - 1))
    unary = {i: [0] * (k + 1) for i in types}  # cost of z_i = 1..k
    levels = range(1, k)
    total = 0
    for i, j, cost in _terms(types, push, pull, alpha, beta, margin_scale):
        bend = {d: cost(d + 1) - 2 * cost(d) + cost(d - 1) for d in range(-k, k + 1)}
        total += sum(cost(d) for d in range(-k, k + 1))
        for a in levels:
            for b in levels:
                if bend[a - b] > 0:
                    network.arc(node(i, a), node(j, b), bend[a - b])
        # the arcs cost sum over a < z_i, b >= z_j of bend(a - b): what remains of the term depends on one variable at a time
        cut = lambda x, y, bend=bend: sum(bend[a - b] for a in range(1, x) for b in range(y, k))
        rest = {(x, y): cost(x - y) - cut(x, y) for x in range(1, k + 1) for y in range(1, k + 1)}
        for x in range(1, k + 1):
            unary[i][x] += rest[x, 1]
            unary[j][x] += rest[1, x] - rest[1, 1]
    endless = 4 * total + 4 * sum(abs(c) for costs in unary.values() for c in costs) + 1
    for i in types:
        for level in levels:
            step = unary[i][level + 1] - unary[i][level]
            if step > 0:
                network.arc(node(i, level), 1, step)
            elif step < 0:
                network.arc(0, node(i, level), -step)
            if level + 1 < k:
                network.arc(node(i, level + 1), node(i, level), endless)
    far = network.saturate(0, 1)
    return {i: 1 + sum(far[node(i, level)] >= 0 for level in levels) for i in types}

"""Minimum-cut labelling of the blocks of one document.

Every block is a node between two terminals, content and boilerplate. What a classifier asks for calling a block
boilerplate is its capacity from the content terminal, what it asks for calling it content the capacity to the boilerplate
terminal; neighbouring blocks are joined by edges, which cost their weight where the labels differ. The minimum cut is the
cheapest labelling. Blocks whose own evidence outweighs all their edges keep it in any minimum cut; they
are settled first, and the maximum flow is run over the rest, by blocking flows in level graphs. The ties are local, so that flows are short.
"""

from __future__ import annotations

from collections import deque

EPSILON = 1e-9


def _settle(own: list[float], near: list[dict[int, float]]) -> dict[int, bool]:
    """Labels that every minimum cut has; ``own`` is changed by the settled neighbours' pull."""
    fixed: dict[int, bool] = {}
    loose = [sum(w.values()) for w in near]  # weight of the ties to nodes that are not settled
    todo = deque(range(len(own)))
    while todo:
        i = todo.popleft()
        if i in fixed or (abs(own[i]) <= loose[i] and loose[i] > EPSILON):
            continue
        fixed[i] = own[i] >= 0
        for j, w in near[i].items():
            loose[j] -= w
            if j not in fixed:
                own[j] += w if fixed[i] else -w
                todo.append(j)
    return fixed


class _Network:
    """Residual capacities of a flow network; both directions of an edge are always there."""

    def __init__(self, n: int) -> None:
        self.cap: list[dict[int, float]] = [{} for _ in range(n)]

    def join(self, u: int, v: int, there: float, back: float) -> None:
        self.cap[u][v] = self.cap[u].get(v, 0.0) + there
        self.cap[v][u] = self.cap[v].get(u, 0.0) + back

    def _levels(self, source: int, sink: int) -> dict[int, int] | None:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in self.cap[u].items():
                if c > EPSILON and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        return level if sink in level else None

    def saturate(self, source: int, sink: int) -> None:
        """Maximum flow."""
        while level := self._levels(source, sink):
            ahead = {u: iter(list(self.cap[u])) for u in level}
            path = [source]
            while path:
                u = path[-1]
                if u == sink:
                    flow = min(self.cap[a][b] for a, b in zip(path, path[1:], strict=False))
                    first = None
                    for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                        self.cap[a][b] -= flow
                        self.cap[b][a] += flow
                        if first is None and self.cap[a][b] <= EPSILON:
                            first = k
                    del path[first + 1 :]  # go on before the first edge that is full
                    continue
                for v in ahead[u]:
                    if self.cap[u][v] > EPSILON and level.get(v) == level[u] + 1:
                        path.append(v)
                        break
                else:
                    path.pop()
                    if path:  # nothing leads on from u
                        level[u] = -1

    def reaching(self, sink: int) -> set[int]:
        """Nodes from which there is capacity left to the sink."""
        behind, queue = {sink}, deque([sink])
        while queue:
            v = queue.popleft()
            for u in self.cap[v]:
                if u not in behind and self.cap[u][v] > EPSILON:
                    behind.add(u)
                    queue.append(u)
        return behind


def label(as_boilerplate: list[float], as_content: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for content: the labelling of least total cost, content where both are equally cheap."""
    n = len(as_boilerplate)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    own = [b - c for b, c in zip(as_boilerplate, as_content, strict=True)]
    fixed = _settle(own, near)
    loose = [i for i in range(n) if i not in fixed]
    if loose:
        at = {i: k for k, i in enumerate(loose)}
        source, sink = len(loose), len(loose) + 1
        net = _Network(len(loose) + 2)
        for i in loose:
            if own[i] > 0:
                net.join(source, at[i], own[i], 0.0)
            else:
                net.join(at[i], sink, -own[i], 0.0)
            for j, w in near[i].items():
                if j in at and i < j:
                    net.join(at[i], at[j], w, w)
        net.saturate(source, sink)
        # boilerplate is what can still reach the sink; what reaches neither is content
        behind = net.reaching(sink)
        fixed |= {i: at[i] not in behind for i in loose}
    return [fixed[i] for i in range(n)]

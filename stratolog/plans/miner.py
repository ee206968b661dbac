"""Net discovery: process trees by recursive cuts of the directly-follows graph (inductive mining), turned into accepting nets.

Each cut splits the traces themselves, so every trace replays.  Where no cut applies, traces are cut into rounds of a loop, and else a loop over all
activities accepts anything.  ``mine`` works on traces in memory; ``traces.mine_all`` takes the same decisions over distributed traces.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from .net import Net

#: A tree is ("leaf", activity or None) or (operator, children) with operators seq, xor, par, loop (body, redo).
Tree = tuple
Log = dict[tuple[str, ...], int]
SILENT: Tree = ("leaf", None)


@dataclass(frozen=True)
class Graph:
    nodes: frozenset[str]
    edges: frozenset[tuple[str, str]]
    starts: frozenset[str]
    ends: frozenset[str]

    @classmethod
    def of(cls, log: Log) -> Graph:
        edges = {(a, b) for t in log for a, b in zip(t, t[1:])}
        return cls(frozenset(a for t in log for a in t), frozenset(edges), frozenset(t[0] for t in log if t), frozenset(t[-1] for t in log if t))


def components(nodes: Iterable[str], links: Iterable[tuple[str, str]]) -> list[frozenset[str]]:
    """Connected components, in the order of their least members."""
    leader = {n: n for n in nodes}

    def find(x: str) -> str:
        while leader[x] != x:
            leader[x] = leader[leader[x]]
            x = leader[x]
        return x

    for a, b in links:
        leader[find(a)] = find(b)
    parts = defaultdict(set)
    for n in leader:
        parts[find(n)].add(n)
    return sorted(map(frozenset, parts.values()), key=min)


def _reach(graph: Graph) -> dict[str, set[str]]:
    after = defaultdict(set)
    for a, b in graph.edges:
        after[a].add(b)
    found = {}
    for n in graph.nodes:
        seen, stack = set(), [n]
        while stack:
            for m in after[stack.pop()] - seen:
                seen.add(m)
                stack.append(m)
        found[n] = seen
    return found


def _choice(graph: Graph) -> list[frozenset[str]] | None:
    parts = components(graph.nodes, graph.edges)
    return parts if len(parts) > 1 else None


def _sequence(graph: Graph) -> list[frozenset[str]] | None:
    reach = _reach(graph)
    # activities that reach each other, or neither the other, stand side by side
    parts = components(graph.nodes, ((a, b) for a in graph.nodes for b in graph.nodes if a < b and (b in reach[a]) == (a in reach[b])))
    if len(parts) < 2:
        return None
    return sorted(parts, key=lambda p: (-len(set().union(*(reach[a] for a in p)) | p), min(p)))


def _parallel(graph: Graph) -> list[frozenset[str]] | None:
    parts = components(graph.nodes, ((a, b) for a in graph.nodes for b in graph.nodes if a < b and not {(a, b), (b, a)} <= graph.edges))
    whole = [p for p in parts if p & graph.starts and p & graph.ends]
    rest = frozenset().union(*(p for p in parts if p not in whole))
    if len(whole) < 2:
        return None
    return [whole[0] | rest, *whole[1:]]


def _loop(graph: Graph) -> list[frozenset[str]] | None:
    """Body first, then the redo parts: left only from ends, entered back only into starts, and connected to all of them or none."""
    body = set(graph.starts | graph.ends)
    rest = components(graph.nodes - body, (e for e in graph.edges if not set(e) & body))
    redo = []
    for part in rest:
        entered = {a for a, b in graph.edges if b in part and a in body}
        left = {b for a, b in graph.edges if a in part and b in body}
        first = {b for a, b in graph.edges if b in part and a in body}
        last = {a for a, b in graph.edges if a in part and b in body}
        fits = entered <= graph.ends and left <= graph.starts and entered and left
        fits = fits and all((e, f) in graph.edges for e in graph.ends for f in first) and all((x, s) in graph.edges for x in last for s in graph.starts)
        if fits:
            redo.append(part)
        else:
            body |= part
    return [frozenset(body), *redo] if redo else None


def _split(log: Log, kind: str, parts: list[frozenset[str]]) -> list[Log]:
    logs: list[Log] = [defaultdict(int) for _ in parts]
    for trace, n in log.items():
        if kind == "xor":
            at = next(k for k, p in enumerate(parts) if trace[0] in p)
            logs[at][trace] += n
        elif kind in ("seq", "par"):
            for own, p in zip(logs, parts):
                own[tuple(a for a in trace if a in p)] += n
        else:
            piece: list[str] = []
            at = 0
            for a in trace:
                where = next(k for k, p in enumerate(parts) if a in p)
                if where != at:
                    logs[at][tuple(piece)] += n
                    if at and where:  # from redo to redo passes an empty body
                        logs[0][()] += n
                    piece, at = [], where
                piece.append(a)
            logs[at][tuple(piece)] += n
            if at:
                logs[0][()] += n
    return [dict(x) for x in logs]


CUTS = (("xor", _choice), ("seq", _sequence), ("par", _parallel), ("loop", _loop))


def _repeats(log: Log, graph: Graph) -> Log | None:
    """The traces cut wherever an end is followed by a start, or None if none of them is: rounds of a loop without anything in between."""
    rounds: Log = defaultdict(int)
    for trace, n in log.items():
        cuts = [0, *(k for k in range(1, len(trace)) if trace[k - 1] in graph.ends and trace[k] in graph.starts), len(trace)]
        for a, b in zip(cuts, cuts[1:]):
            rounds[trace[a:b]] += n
    return dict(rounds) if sum(rounds.values()) > sum(log.values()) else None


def flower(activities: Iterable[str]) -> Tree:
    return ("loop", (SILENT, *(("leaf", a) for a in sorted(activities))))


def joined(kind: str, children: list[Tree]) -> Tree:
    if kind == "loop" and len(children) > 2:
        children = [children[0], ("xor", tuple(children[1:]))]
    return (kind, tuple(children))


def mine(log: Log) -> Tree:
    """A process tree that accepts every trace of a multiset of traces."""
    if () in log:
        rest = {t: n for t, n in log.items() if t}
        return ("xor", (SILENT, mine(rest))) if rest else SILENT
    graph = Graph.of(log)
    if len(graph.nodes) == 1:
        leaf = ("leaf", next(iter(graph.nodes)))
        return leaf if all(len(t) == 1 for t in log) else ("loop", (leaf, SILENT))
    for kind, cut in CUTS:
        if parts := cut(graph):
            return joined(kind, [mine(x) for x in _split(log, kind, parts)])
    if rounds := _repeats(log, graph):
        return ("loop", (mine(rounds), SILENT))
    return flower(graph.nodes)


def to_net(tree: Tree) -> Net:
    """The accepting net of a tree; names of places and silent transitions follow the order of construction."""
    places, transitions, arcs = ["source", "sink"], {}, []

    def place() -> str:
        places.append(f"p{len(places) - 1}")
        return places[-1]

    def step(a: str | list[str], b: str | list[str], label: str | None) -> None:
        name = f"t{len(transitions) + 1}"
        transitions[name] = label
        arcs.extend((p, name) for p in ([a] if isinstance(a, str) else a))
        arcs.extend((name, p) for p in ([b] if isinstance(b, str) else b))

    def build(node: Tree, a: str, b: str) -> None:
        kind, content = node
        if kind == "leaf":
            step(a, b, content)
        elif kind == "xor":
            for child in content:
                build(child, a, b)
        elif kind == "seq":
            marks = [a, *(place() for _ in content[1:]), b]
            for child, x, y in zip(content, marks, marks[1:]):
                build(child, x, y)
        elif kind == "par":
            ends = [(place(), place()) for _ in content]
            step(a, [x for x, _ in ends], None)
            for child, (x, y) in zip(content, ends):
                build(child, x, y)
            step([y for _, y in ends], b, None)
        else:
            x, y = place(), place()
            step(a, x, None)
            build(content[0], x, y)
            for redo in content[1:]:
                build(redo, y, x)
            step(y, b, None)

    build(tree, "source", "sink")
    return Net(tuple(places), transitions, tuple(arcs), frozenset({"source"}), frozenset({"sink"}))


def discover(log: Log) -> Net:
    return to_net(mine(log))


def replays(net: Net, trace: tuple[str, ...], most: int = 100_000) -> bool:
    """Whether the net accepts the trace, by search over markings."""
    before, after = defaultdict(set), defaultdict(set)
    for a, b in net.arcs:
        if a in net.transitions:
            after[a].add(b)
        else:
            before[b].add(a)
    state = (net.initial, 0)
    seen, stack = {state}, [state]
    while stack:
        marking, at = stack.pop()
        if at == len(trace) and marking == net.final:
            return True
        if len(seen) > most:
            raise RuntimeError("too many markings")
        for t, label in net.transitions.items():
            if before[t] <= marking and (label is None or (at < len(trace) and label == trace[at])):
                new = (frozenset(marking - before[t] | after[t]), at + (label is not None))
                if new not in seen:
                    seen.add(new)
                    stack.append(new)
    return False

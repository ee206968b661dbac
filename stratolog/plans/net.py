"""Object-centric Petri nets as plain data, their merged graph, and their tables."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Net:
    """One object type's accepting net.  Transitions map a name to a label (None: silent); arcs connect names of places and transitions."""

    places: tuple[str, ...]
    transitions: Mapping[str, str | None]
    arcs: tuple[tuple[str, str], ...]
    initial: frozenset[str] = frozenset()
    final: frozenset[str] = frozenset()

    def __post_init__(self):
        names = [*self.places, *self.transitions]
        if len(set(names)) != len(names):
            raise ValueError("places and transitions need names of their own")
        for a, b in self.arcs:
            if (a in self.transitions) == (b in self.transitions) or not {a, b} <= set(names):
                raise ValueError(f"no arc between a place and a transition: {a} -> {b}")


def from_chains(*chains: str, activities: Iterable[str], silent: Iterable[str] = ()) -> Net:
    """A net written as chains ``a>b>c`` of names: those in ``activities`` are transitions of that label, those in ``silent`` silent ones, the rest places."""
    arcs = {arc for chain in chains for arc in pairwise(chain.split(">"))}
    names = {name for arc in arcs for name in arc}
    transitions = {x: x for x in sorted(names & {*activities})} | dict.fromkeys(sorted(names & {*silent}))
    return Net(tuple(sorted(names - set(transitions))), transitions, tuple(sorted(arcs)))


@dataclass(frozen=True)
class OCNet:
    """Nets by object type; ``variable`` holds (type, activity) whose arcs carry several objects, ``diagnostics`` replay counts by type and node."""

    nets: Mapping[str, Net]
    variable: frozenset[tuple[str, str]] = frozenset()
    diagnostics: Mapping[str, Mapping[str, object]] = field(default_factory=dict)

    @property
    def activities(self) -> list[str]:
        return sorted({x for net in self.nets.values() for x in net.transitions.values() if x is not None})


#: Keys: ("activity", label) for labelled transitions of all types, ("silent", type, name), ("place", type, name), ("arc", type, source, target).
Key = tuple[str, ...]


def transition_key(otype: str, name: str, label: str | None) -> Key:
    return ("silent", otype, name) if label is None else ("activity", label)


@dataclass
class Merged:
    """One graph of all types: transitions with the same label are one node."""

    places: list[Key] = field(default_factory=list)
    transitions: dict[Key, str | None] = field(default_factory=dict)
    arcs: dict[Key, tuple[Key, Key]] = field(default_factory=dict)
    producers: dict[Key, set[Key]] = field(default_factory=lambda: defaultdict(set))  # place -> transitions
    consumers: dict[Key, set[Key]] = field(default_factory=lambda: defaultdict(set))
    inputs: dict[Key, set[Key]] = field(default_factory=lambda: defaultdict(set))  # transition -> places
    outputs: dict[Key, set[Key]] = field(default_factory=lambda: defaultdict(set))

    def place_graph(self, otype: str) -> dict[Key, set[Key]]:
        """place -> places that one transition leads to, within a type."""
        graph: dict[Key, set[Key]] = {p: set() for p in self.places if p[1] == otype}
        for t in self.transitions:
            for p in self.inputs[t]:
                if p[1] == otype:
                    graph[p] |= {q for q in self.outputs[t] if q[1] == otype}
        return graph


def merge(model: OCNet) -> Merged:
    merged = Merged()
    for otype, net in sorted(model.nets.items()):
        merged.places += [("place", otype, p) for p in sorted(net.places)]
        key = {name: transition_key(otype, name, label) for name, label in net.transitions.items()}
        for name, label in net.transitions.items():
            merged.transitions[key[name]] = label
        for a, b in net.arcs:
            if a in key:
                t, p = key[a], ("place", otype, b)
                merged.outputs[t].add(p)
                merged.producers[p].add(t)
                ends = t, p
            else:
                t, p = key[b], ("place", otype, a)
                merged.inputs[t].add(p)
                merged.consumers[p].add(t)
                ends = p, t
            merged.arcs["arc", otype, a, b] = ends
    return merged


def net_arcs(spark: SparkSession, models: Iterable[tuple[int, OCNet]]) -> DataFrame:
    """layer, otype, source, target, source_kind, label, variable of every arc."""
    rows = []
    for layer, model in models:
        for otype, net in sorted(model.nets.items()):
            for a, b in sorted(net.arcs):
                label = net.transitions.get(a, net.transitions.get(b))
                rows.append((layer, otype, a, b, "transition" if a in net.transitions else "place", label, (otype, label) in model.variable))
    return spark.createDataFrame(rows, "layer int, otype string, source string, target string, source_kind string, label string, variable boolean")


def node_name(key: Key) -> str:
    """A transition's or place's name: the label, or the type and the name within it."""
    return key[1] if key[0] == "activity" else f"{key[1]}/{key[2]}"


def describe(key: Key) -> dict[str, str]:
    """A node's key as a record."""
    if key[0] == "activity":
        return {"kind": "activity", "label": key[1]}
    if key[0] == "silent":
        return {"kind": "silent", "object_type": key[1], "name": key[2]}
    return {"object_type": key[1], "name": key[2]}

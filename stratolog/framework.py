"""The whole analysis of a log: scores, layers, a net for each layer and its fragments."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .log import Log
from .operators import flows, scores, sublog
from .plans import fragments, layers, miner, net, render, traces


@dataclass(frozen=True)
class LayerModel:
    layer: int
    object_types: list[str]
    activities: list[str]
    resources: dict[str, list[str]]
    highlighted: list[str]
    net: net.OCNet | None
    fragments: list[fragments.Fragment]


def matrices(frame: DataFrame) -> tuple[dict, dict]:
    """push and pull as dictionaries: types squared, the only thing that reaches the driver before the solver."""
    rows = frame.collect()
    return tuple({(r["source_type"], r["target_type"]): r[kind] for r in rows} for kind in ("push", "pull"))


def discover_nets(relations: DataFrame) -> dict[int, net.OCNet]:
    """A net per layer, mined from the distinct traces of its types, where they are."""
    variants = flows.object_variants(relations)
    names = {(r["layer"], r["otype"]): f"{k}" for k, r in enumerate(sorted(relations.select("layer", "otype").distinct().collect()))}
    rows = [(layer, otype, name) for (layer, otype), name in names.items()]
    known = F.broadcast(relations.sparkSession.createDataFrame(rows, "layer int, otype string, log string"))  # types in layers
    found_trees = traces.mine_all(variants.join(known, ["layer", "otype"]).select("log", "trace"))
    trees = {k: found_trees[name] for k, name in names.items()}
    variable = defaultdict(set)
    for r in flows.arc_multiplicity(relations).where("variable").collect():
        variable[r["layer"]].add((r["otype"], r["activity"]))
    found: dict[int, dict] = defaultdict(dict)
    for (layer, otype), tree in sorted(trees.items()):
        found[layer][otype] = miner.to_net(tree)
    return {layer: net.OCNet(nets, frozenset(variable[layer])) for layer, nets in found.items()}


class Discovery:
    """Steps: ``prepare``, ``assign_scores``, ``solve_ilp`` (or ``get_layers`` for all three), ``discover_models``, ``visualize``."""

    def __init__(self, log: Log, scorers: Sequence[scores.Scorer] | None = None):
        self.log = log
        self.scorers = scores.default_scorers() if scorers is None else list(scorers)
        self.scores: DataFrame | None = None
        self.scores_push: dict[tuple[str, str], float] = {}
        self.scores_pull: dict[tuple[str, str], float] = {}
        self.solution: dict[str, int] | None = None
        self.activity_to_layer: dict[str, int] | None = None
        self.discovered_models: dict[int, LayerModel] | None = None

    def prepare(self) -> Discovery:
        self.log.keep()
        return self

    def assign_scores(self) -> DataFrame:
        self.scores = scores.score_matrix(self.log, self.scorers)
        self.scores_push, self.scores_pull = matrices(self.scores)
        return self.scores

    def solve_ilp(self, **how) -> dict[str, int]:
        types = sorted({a for a, _ in self.scores_push})
        self.solution = layers.solve(types, self.scores_push, self.scores_pull, **how)
        return self.solution

    def get_layers(self) -> dict[str, int]:
        self.prepare()
        self.assign_scores()
        return self.solve_ilp()

    def discover_models(self, layer_context: Sequence[int] | None = None) -> dict[int, LayerModel]:
        if self.solution is None:
            raise ValueError("models need layers: call get_layers() first")
        known = sorted(set(self.solution.values()))
        context = sublog.normalise_context(known, layer_context)
        self.discovered_models = {}
        if not known:
            self.activity_to_layer = {}
            return self.discovered_models
        spark = self.log.events.sparkSession
        logs = sublog.LayerLogs(self.log, sublog.layer_frame(spark, self.solution), context)
        self.activity_to_layer = {r[0]: r[1] for r in logs.activity_layer().collect()}
        resources: dict[int, dict[str, list[str]]] = defaultdict(dict)
        for r in logs.activity_resources().collect():
            resources[r["layer"]][r["activity"]] = list(r["resources"])
        highlighted = defaultdict(list)
        for r in logs.highlighted_activities().collect():
            highlighted[r["layer"]].append(r["activity"])
        nets = discover_nets(logs.relations())
        for layer in known:
            model = nets.get(layer)
            found = fragments.detect(model, self.activity_to_layer, layer)
            types = sorted(t for t, n in self.solution.items() if n == layer)
            self.discovered_models[layer] = LayerModel(layer, types, sorted(resources[layer]), resources[layer], sorted(highlighted[layer]), model, found)
        return self.discovered_models

    def visualize_layers(self, title: str = "Hierarchy Layers", output_path: str | Path | None = None) -> str:
        return _put(render.layers_page(self.solution or {}, title), output_path)

    def visualize(self, title: str = "Hierarchy with Process Models", output_path: str | Path | None = None) -> str:
        return _put(render.hierarchy_page(self.solution or {}, self.discovered_models or {}, title), output_path)


def _put(page: str, path: str | Path | None) -> str:
    if path is not None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(page, encoding="utf-8")
    return page


def format_matrices(push: Mapping[tuple[str, str], float], pull: Mapping[tuple[str, str], float], decimals: int = 4) -> str:
    """Both matrices as aligned text, types in order of appearance."""
    parts = []
    for name, scores_ in (("push", push), ("pull", pull)):
        if not isinstance(scores_, Mapping):
            raise TypeError(f"{name} must map pairs of types to numbers")
        if any(not isinstance(k, tuple) or len(k) != 2 for k in scores_):
            raise ValueError(f"{name} must have pairs of types as keys")
        rows, columns = (list(dict.fromkeys(k[i] for k in scores_)) for i in (0, 1))
        cells = [[name, *columns], *([r, *(f"{scores_[r, c]:.{decimals}f}" if (r, c) in scores_ else "" for c in columns)] for r in rows)]
        widths = [max(len(line[k]) for line in cells) for k in range(len(columns) + 1)]
        parts.append("\n".join("  ".join(x.rjust(w) for x, w in zip(line, widths)) for line in cells))
    return "\n\n".join(parts)

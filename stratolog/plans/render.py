"""Pictures as text: nets in DOT, layers and the whole hierarchy as HTML.  Node ids and order are deterministic."""

from __future__ import annotations

import html
import textwrap
from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence

from ..functions.palette import type_colors
from .fragments import Fragment
from .net import Key, OCNet, transition_key

#: Fixed value: the fill of highlighted activities.
HIGHLIGHT = "#f7d7a6"
FALLBACK = "#cccccc"


def _quoted(text: object) -> str:
    return '"' + str(text).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def _attributes(pairs: Mapping[str, object]) -> str:
    return ", ".join(f"{k}={v if k == 'label' and str(v).startswith('<') else _quoted(v)}" for k, v in pairs.items() if v is not None)


def activity_label(activity: str, resources: Sequence[str], colors: Mapping[str, str]) -> str:
    """The name, followed by a dot in the colour of each resource type."""
    name = html.escape(activity)
    dots = "".join(f'<FONT COLOR="{colors.get(t, FALLBACK)}">&#9679;</FONT>' for t in resources)
    return f"<{name}<BR/>{dots}>" if dots else f"<{name}>"


def fragment_styles(fragments: Iterable[Fragment]) -> dict[Key, tuple[str, ...]]:
    """The colours of the fragments that each node and arc belongs to, in order and without repeats."""
    styles: dict[Key, dict[str, None]] = defaultdict(dict)
    for f in fragments:
        for key in (*f.transitions, *f.places, *f.arcs):
            styles[key][f.color] = None
    return {k: tuple(v) for k, v in styles.items()}


def _border(colors: Sequence[str]) -> dict[str, object]:
    if not colors:
        return {}
    return {"color": colors[0], "penwidth": 2.5, "peripheries": len(colors) if len(colors) > 1 else None}


def net_dot(
    model: OCNet,
    colors: Mapping[str, str] | None = None,
    resources: Mapping[str, Sequence[str]] | None = None,
    highlighted: Iterable[str] = (),
    fragments: Iterable[Fragment] = (),
    title: str | None = None,
    rankdir: str = "LR",
    bgcolor: str = "white",
) -> str:
    """The nets of all types in one graph; transitions of one activity share a node."""
    colors = dict(type_colors(model.nets)) | dict(colors or {})
    resources, highlighted, styles = resources or {}, set(highlighted), fragment_styles(fragments)
    lines = ["digraph ocpn {", f"  graph [{_attributes({'bgcolor': bgcolor, 'rankdir': rankdir, 'nodesep': '0.1', 'ranksep': '0.2'})}];", '  node [shape="ellipse", fixedsize="false"];']
    if title:
        heading = f'<<FONT POINT-SIZE="20">{html.escape(title)}</FONT>>'
        lines.append(f"  graph [label={heading}, labelloc=top];")
    ids: dict[Key, str] = {}

    def node(key: Key, **pairs: object) -> None:
        ids[key] = f"n{len(ids)}"
        lines.append(f"  {ids[key]} [{_attributes(pairs | _border(styles.get(key, ())))}];")

    for activity in model.activities:
        fill = {"style": "filled", "fillcolor": HIGHLIGHT} if activity in highlighted else {}
        node(("activity", activity), label=activity_label(activity, resources.get(activity, ()), colors), shape="box", **fill)
    for otype, net in sorted(model.nets.items()):
        color, found = colors[otype], model.diagnostics.get(otype, {})
        for place in net.places:
            look: dict[str, object] = {"label": " ", "shape": "circle", "style": "filled", "fillcolor": color}
            if place in net.initial:
                look |= {"label": otype, "shape": "ellipse"}
            elif place in net.final:
                look = {"label": otype, "shape": "underline", "fontcolor": color}
            elif place in found:
                counts = found[place]
                look |= {"label": "p={p} m={m}\nc={c} r={r}".format(**counts), "shape": "ellipse"}
            node(("place", otype, place), **look)
        for name, label in net.transitions.items():
            if label is None:
                node(("silent", otype, name), label=" ", shape="box", style="filled", fillcolor=color)
        for a, b in net.arcs:
            t = a if a in net.transitions else b
            key = {x: transition_key(otype, x, net.transitions[x]) if x in net.transitions else ("place", otype, x) for x in (a, b)}
            marks = styles.get(("arc", otype, a, b), ())
            width = max(4.0 if (otype, net.transitions[t]) in model.variable else 1.0, 3.0 if marks else 0.0)
            look = {"color": ":".join(marks) or color, "penwidth": width, "label": found.get(t, " ")}
            lines.append(f"  {ids[key[a]]} -> {ids[key[b]]} [{_attributes(look)}];")
    return "\n".join([*lines, "}"]) + "\n"


def layers_of(solution: Mapping[str, int]) -> list[tuple[int, list[str]]]:
    """(layer, sorted types), top layer first."""
    rows = defaultdict(list)
    for otype, layer in sorted(solution.items()):
        rows[layer].append(otype)
    return sorted(rows.items(), reverse=True)


def layers_text(solution: Mapping[str, int]) -> str:
    return "\n".join(f"Layer {layer}: {', '.join(types)}" for layer, types in layers_of(solution))


def wrapped(types: Sequence[str], width: int = 18) -> list[list[str]]:
    """Names of types as lines of at most ``width`` characters where blanks and separators allow; no name gives None."""
    return [textwrap.wrap(t.replace("_", "_ "), width) or ["None"] for t in types] or [["None"]]


_STYLE = "body{font-family:sans-serif} .layer{border:1px solid #999;border-radius:8px;margin:12px;padding:8px} .type{display:inline-block;border-radius:6px;padding:4px 8px;margin:3px} pre{overflow:auto;background:#f6f6f6;padding:8px}"


def _page(title: str, body: Iterable[str]) -> str:
    name = html.escape(title)
    return f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{name}</title><style>{_STYLE}</style></head><body><h1>{name}</h1>\n' + "\n".join(body) + "\n</body></html>\n"


def _boxes(types: Sequence[str], colors: Mapping[str, str]) -> str:
    return "".join(f'<span class="type" style="background:{colors.get(t, FALLBACK)}">{"<br>".join(map(html.escape, lines))}</span>' for t, lines in zip(types or [""], wrapped(types)))


def layers_page(solution: Mapping[str, int], title: str = "Hierarchy Layers") -> str:
    colors = type_colors(solution)
    return _page(title, (f'<div class="layer"><b>Layer {n}</b> {_boxes(types, colors)}</div>' for n, types in layers_of(solution)))


def hierarchy_page(solution: Mapping[str, int], models: Mapping[int, object], title: str = "Hierarchy with Process Models") -> str:
    """One row per layer, top first: its types, and its net as DOT source or a note that there is none."""
    colors = type_colors(solution)
    body = []
    for layer, types in layers_of(solution):
        model = models.get(layer)
        net = getattr(model, "net", None)
        if net is None:
            picture = "<p>No events for this layer</p>"
        else:
            picture = f"<pre>{html.escape(net_dot(net, colors, model.resources, model.highlighted, model.fragments, f'Layer {layer}'))}</pre>"
        body.append(f'<div class="layer"><h2>Layer {layer}</h2>{_boxes(types, colors)}{picture}</div>')
    return _page(title, body)

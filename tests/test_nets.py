"""Nets: fragments, mining and rendering."""

import random
import re
from collections import defaultdict
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratolog.functions.palette import fragment_colors, type_colors
from stratolog.plans import fragments, miner, render
from stratolog.plans.fragments import BudgetExceeded, Fragment, detect
from stratolog.plans.net import Net, OCNet, merge
from stratolog.plans.net import from_chains as net
from stratolog.plans.traces import mine_all


def found(nets, inside, outside=()):
    levels = dict.fromkeys(inside, 1) | dict.fromkeys(outside, 2)
    return detect(OCNet(nets), levels, 2)


def labels(fragment):
    return {t[1] for t in fragment.transitions}


def test_two_types():
    nets = {
        "item": net("start_item>item_in>pack>item_mid>ship>item_out>end_item", activities=("start_item", "pack", "ship", "end_item")),
        "order": net("start_order>order_in>pack>order_out>end_order", activities=("start_order", "pack", "end_order")),
    }
    (one,) = found(nets, ("pack", "ship"), ("start_item", "end_item", "start_order", "end_order"))
    assert one.object_types == ("item", "order") and labels(one) == {"pack", "ship"}
    assert len(one.places) == 5 and len(one.arcs) == 6
    record = one.record(merge(OCNet(nets)))
    assert {t["label"] for t in record["transitions"]} == {"pack", "ship"} and len(record["arcs"]) == 6


def test_global_input_may_start():
    (one,) = found({"t": net("in>a>mid>b>out>end", activities=("a", "b", "end"))}, "ab", ("end",))
    assert labels(one) == {"a", "b"}


def test_global_final_may_end():
    (one,) = found({"t": net("start>in>a>mid>b>out", activities=("start", "a", "b"))}, "ab", ("start",))
    assert labels(one) == {"a", "b"}


def test_way_outside_is_allowed():
    got = found({"t": net("in>a>mid>b>out", "in>x>ext>y>out", activities="abxy")}, "ab", "xy")
    assert {"a", "b"} in map(labels, got)


def test_mixed_way_is_not():
    got = found({"t": net("in_1>a>mid>b>out", "in_2>d>out", "in_1>x>ext>y>in_2", activities="abdxy")}, "abd", "xy")
    assert {"a", "b"} in map(labels, got) and {"a", "b", "d"} not in map(labels, got)


def test_disconnected_is_not_combined():
    nets = {"t": net("start_left>left_in>left>left_out>end_left", "start_right>right_in>right>right_out>end_right", activities=("start_left", "left", "end_left", "start_right", "right", "end_right"))}
    assert found(nets, ("left", "right"), ("start_left", "end_left", "start_right", "end_right")) == []


def test_two_outputs():
    nets = {"t": net("start>in>a>mid_left>bridge>mid_right>c>out>end", "bridge>dead", activities=("start", "a", "bridge", "c", "end"))}
    assert found(nets, ("a", "bridge", "c"), ("start", "end")) == []


def random_net(rng):
    nets = {}
    for otype in ("x", "y")[: rng.randint(1, 2)]:
        places = [f"p{k}" for k in range(rng.randint(2, 5))]
        transitions = {f"t{k}": (f"act{k}" if rng.random() < 0.8 else None) for k in range(rng.randint(1, 5))}
        arcs = set()
        for t in transitions:
            for p in rng.sample(places, rng.randint(0, 2)):
                arcs.add((p, t))
            for p in rng.sample(places, rng.randint(0, 2)):
                arcs.add((t, p))
        nets[otype] = Net(tuple(places), transitions, tuple(sorted(arcs)))
    return OCNet(nets)


def feasible(graph, chosen):
    """Straight from the definition, with walks by repeated squaring of sets."""
    if not chosen or len(fragments.linked(graph, set(chosen))) != 1:
        return False
    touched = {p for t in chosen for p in graph.inputs[t] | graph.outputs[t]}
    for p in touched:
        fed, drawn = graph.producers[p] & chosen, graph.consumers[p] & chosen
        if fed and drawn and not (graph.producers[p] | graph.consumers[p]) <= chosen:
            return False
    for otype in {p[1] for p in touched}:
        own = {p for p in touched if p[1] == otype}
        entry = [p for p in own if not graph.producers[p] & chosen]
        exit_ = [p for p in own if not graph.consumers[p] & chosen]
        if len(entry) != 1 or len(exit_) != 1:
            return False
        step = defaultdict(set)
        for t in chosen:
            for p in graph.inputs[t]:
                step[p] |= graph.outputs[t]
        reach = {p: {p} for p in own}
        for _ in own:
            reach = {p: r.union(*(step[q] & own for q in r)) for p, r in reach.items()}
        if any(p not in reach[entry[0]] or exit_[0] not in reach[p] for p in own):
            return False
        full = graph.place_graph(otype)
        states, stack = set(), [(entry[0], False, False)]
        while stack:
            p, inside, outside = stack.pop()
            for q in full[p]:
                if q == exit_[0]:
                    if inside and outside:
                        return False
                    state = (q, inside, outside)
                else:
                    state = (q, inside or q in own, outside or q not in own)
                if state not in states:
                    states.add(state)
                    stack.append(state)
    return True


def test_maximal_sets_equal_brute_force():
    rng = random.Random(1)
    some = 0
    for _ in range(400):
        graph = merge(random_net(rng))
        for part in fragments.linked(graph, set(graph.transitions)):
            good = [frozenset(c) for n in range(1, len(part) + 1) for c in combinations(sorted(part), n) if feasible(graph, frozenset(c))]
            best = {g for g in good if not any(g < h for h in good)}
            assert set(fragments.maximal_feasible(graph, part)) == best
            some += len(best) > 0
    assert some > 100


def test_budget_is_explicit():
    parts = [f"in{k}>t{k}>out{k}" for k in range(8)] + [f"out{k}>t{(k * 3 + 1) % 8}" for k in range(8)]
    graph = merge(OCNet({"t": net(*parts, activities=[f"t{k}" for k in range(8)])}))
    with pytest.raises(BudgetExceeded):
        fragments.maximal_feasible(graph, frozenset(graph.transitions), budget=3)


def test_no_net_no_fragments():
    assert detect(None, {}, 1) == []


def test_net_checks_names():
    with pytest.raises(ValueError):
        Net(("a",), {"a": "x"}, ())
    with pytest.raises(ValueError):
        Net(("a", "b"), {}, (("a", "b"),))


# mining

traces = st.lists(st.lists(st.sampled_from("abcde"), max_size=6).map(tuple), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(traces)
def test_mined_nets_replay_their_traces(log):
    mined = miner.discover({t: 1 for t in log})
    for t in log:
        assert miner.replays(mined, t)


@settings(max_examples=100, deadline=None)
@given(traces)
def test_nets_are_workflow_nets(log):
    mined = miner.discover({t: 1 for t in log})
    into, out = {b for _, b in mined.arcs}, {a for a, _ in mined.arcs}
    assert {p for p in mined.places if p not in into} == {"source"} and {p for p in mined.places if p not in out} == {"sink"}
    assert all(t in into and t in out for t in mined.transitions)


@pytest.mark.parametrize(
    "log, yes, no",
    [
        (["abc", "acb"], ["abc", "acb"], ["ab", "bac"]),
        (["ab", "ac"], ["ab"], ["abc", "a"]),
        (["ab", "abab", "ababab"], ["abababab"], ["a", "aba"]),
        (["abd", "acd", "ad"], ["ad"], ["abcd", "d"]),
    ],
)
def test_known_behaviour(log, yes, no):
    mined = miner.discover({tuple(t): 1 for t in log})
    assert all(miner.replays(mined, tuple(t)) for t in yes)
    assert not any(miner.replays(mined, tuple(t)) for t in no)


def test_distributed_mining_equals_mining_in_memory(spark):
    rng = random.Random(11)
    logs = [["abcd"], ["abd", "acd"], ["abcd", "acbd"], ["abc", "acb", "bac", "bca", "cab", "cba"], ["ab", "acbab", "abcab"], ["ad", "abd"], ["aa", "a"], ["", "a", "bb"], [""], ["ab", "abab", "ababab"], ["bca", "a", "acdbca"]]
    for _ in range(60):
        letters = "abcdefg"[: rng.randint(1, 7)]
        logs.append(["".join(rng.choice(letters) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 6))])
    rows = [(f"log{k}", list(t)) for k, log in enumerate(logs) for t in log]
    found = mine_all(spark.createDataFrame(rows, "log string, trace array<string>").repartition(3))
    assert found == {f"log{k}": miner.mine({tuple(t): 1 for t in log}) for k, log in enumerate(logs)}


def test_distributed_mining_of_nothing(spark):
    assert mine_all(spark.createDataFrame([], "log string, trace array<string>")) == {}


# rendering


def test_palettes_differ():
    assert len(set(fragment_colors(24))) == 24 and len(set(fragment_colors(300))) == 300
    assert all(re.fullmatch("#[0-9a-f]{6}", c) for c in fragment_colors(30))
    colors = type_colors(["b", "a", "c"] + [f"t{k}" for k in range(40)])
    assert len(set(colors.values())) == 43 and colors["a"] == type_colors(["a"])["a"]


def test_fragment_colours_in_dot():
    model = OCNet({"t": net("start>in>a>mid>b>out>end", activities=("start", "a", "b", "end"))})
    (one,) = detect(model, {"a": 1, "b": 1, "start": 2, "end": 2}, 2)
    one = Fragment(one.id, "#123abc", one.object_types, one.transitions, one.places, one.arcs)
    dot = render.net_dot(model, fragments=[one])
    assert dot.count("#123abc") >= 6 and 'fillcolor="#123abc"' not in dot


def test_overlap_keeps_both_colours():
    model = OCNet({"t": net("start>in>a>out>end", activities=("start", "a", "end"))})
    arc = ("arc", "t", "in", "a")
    both = [Fragment(f"f{k}", c, ("t",), (("activity", "a"),), (), (arc,)) for k, c in enumerate(("#123abc", "#456def"))]
    dot = render.net_dot(model, fragments=both)
    assert 'color="#123abc:#456def"' in dot and 'peripheries="2"' in dot


def test_dot_details():
    inner = Net(("s", "m", "e"), {"t1": "a&b", "t2": None}, (("s", "t1"), ("t1", "m"), ("m", "t2"), ("t2", "e")), frozenset({"s"}), frozenset({"e"}))
    model = OCNet({"order": inner}, frozenset({("order", "a&b")}), {"order": {"m": {"p": 1, "m": 2, "c": 3, "r": 4}, "t2": 7}})
    dot = render.net_dot(model, resources={"a&b": ["supplier"]}, colors={"supplier": "#010203"}, highlighted=["a&b"], title="T<1>")
    assert dot == render.net_dot(model, resources={"a&b": ["supplier"]}, colors={"supplier": "#010203"}, highlighted=["a&b"], title="T<1>")
    for part in ("a&amp;b", "#010203", render.HIGHLIGHT, 'penwidth="4.0"', r"p=1 m=2\nc=3 r=4", 'label="7"', 'shape="underline"', "T&lt;1&gt;", 'label="order"'):
        assert part in dot


def test_layers_as_text_and_pages():
    assert render.layers_text({"item": 1, "order": 2, "box": 1}) == "Layer 2: order\nLayer 1: box, item"
    assert render.wrapped([]) == [["None"]] and render.wrapped([""]) == [["None"]]
    page = render.hierarchy_page({"item": 1}, {})
    assert "No events for this layer" in page and "Layer 1" in page
    assert "<h1>Hierarchy Layers</h1>" in render.layers_page({})

"""The solver against brute force."""

from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratolog.plans import layers

TYPES = "abcd"
PAIRS = [(i, j) for i in TYPES for j in TYPES if i != j]


def brute(types, push, pull, **how):
    best = {}
    for z in product(range(1, len(types) + 1), repeat=len(types)):
        solution = dict(zip(types, z))
        best.setdefault(layers.objective(solution, push, pull, **how), []).append(solution)
    least = best[min(best)]
    return min(best), {t: min(s[t] for s in least) for t in types}


score = st.floats(-1, 1).map(lambda x: round(x, 2))


@settings(max_examples=120, deadline=None)
@given(st.lists(score, min_size=12, max_size=12), st.lists(st.floats(0, 1).map(lambda x: round(x, 2)), min_size=12, max_size=12), st.sampled_from([0, 1, 0.37]))
def test_least_minimiser(push, pull, margin_scale):
    push = {p: (x if p[0] < p[1] else -dict(zip(PAIRS, push))[p[1], p[0]]) for p, x in zip(PAIRS, push)}
    pull = {p: (x if p[0] < p[1] else dict(zip(PAIRS, pull))[p[1], p[0]]) for p, x in zip(PAIRS, pull)}
    value, least = brute(TYPES, push, pull, margin_scale=margin_scale)
    found = layers.solve(TYPES, push, pull, margin_scale=margin_scale)
    assert layers.objective(found, push, pull, margin_scale=margin_scale) == value
    assert found == least


def test_push_puts_the_first_above():
    assert layers.solve(["order", "item"], {("order", "item"): 0.6, ("item", "order"): -0.6}, {}) == {"item": 1, "order": 2}


def test_pull_holds_together_and_small_cases():
    assert layers.solve(["a", "b"], {}, {("a", "b"): 1.0, ("b", "a"): 1.0}) == {"a": 1, "b": 1}
    assert layers.solve([], {}, {}) == {}
    assert layers.solve(["a"], {}, {}) == {"a": 1}


def test_report(capsys):
    push, pull = {("a", "b"): 0.5}, {("a", "b"): 0.25}
    found = layers.solve(["a", "b"], push, pull, verbose=True)
    shown = capsys.readouterr().out.splitlines()
    assert shown == ["status: optimal", "objective: 0.25", f"a  {found['a']}", f"b  {found['b']}"]
    assert layers.report(found, push, pull, margin_scale=1).splitlines()[1] == "objective: 0.5"


@pytest.mark.parametrize("score, scaled", [(0.5, 500_000_000), (-0.25, -250_000_000), (0.0, 0), (2.5e-9, 3), (-2.5e-9, -3)])
def test_quantise(score, scaled):
    assert layers.quantise(score) == scaled

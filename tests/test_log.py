"""Relational operators against a naive restatement, layers of the star-schema log, and the whole analysis."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest

from stratolog.framework import Discovery, format_matrices
from stratolog.log import Log
from stratolog.operators import flows, scores, sublog
from stratolog.sources.star import order_to_cash

SF = "/root/testdata/sf0.001"


def random_log(seed):
    rng = random.Random(seed)
    objects = {f"{t}{k}": t for t in "xyz" for k in range(rng.randint(1, 5))}
    events, e2o = [], []
    for k in range(25):
        ts = dt.datetime(2020, 1, 1) + dt.timedelta(hours=rng.randint(0, 30)) if rng.random() < 0.9 else None
        events.append((f"e{k}", rng.choice("abc"), ts))
        for o in rng.sample(sorted(objects), rng.randint(0, min(4, len(objects)))):
            e2o.append((f"e{k}", o))
    e2o += [("e0", "ghost")] + e2o[:3]
    o2o = [tuple(rng.sample(sorted([*objects, "ghost"]), 2)) for _ in range(4)]
    return events, objects, e2o, o2o


def frames(spark, events, objects, e2o, o2o):
    return Log.from_tables(
        spark.createDataFrame(events, "eid string, activity string, ts timestamp_ntz"),
        spark.createDataFrame(list(objects.items()), "oid string, otype string"),
        spark.createDataFrame(e2o, "eid string, oid string"),
        spark.createDataFrame(o2o, "src string, dst string"),
    )


def naive_scores(events, objects, e2o, o2o):
    """Event by event, with sets."""
    own = defaultdict(set)
    for e, o in e2o:
        if o in objects:
            own[e].add(o)
    part, rel, life = set(), defaultdict(set), {}
    for e, _, ts in events:
        part |= own[e]
        for o in own[e]:
            rel[o] |= own[e]
            if ts is not None:
                lo, hi = life.get(o, (ts, ts))
                life[o] = min(lo, ts), max(hi, ts)
    for a, b in o2o:
        if a in part and b in part:
            rel[a].add(b)
            rel[b].add(a)
    types = sorted({objects[o] for o in part})
    members = {t: [o for o in part if objects[o] == t] for t in types}
    to = lambda o, t: {p for p in rel[o] if objects[p] == t}
    time, card, div, inter = {}, {}, {}, {}
    for s in types:
        for t in types:
            total = d = i = 0
            signatures = Counter()
            for o in members[s]:
                for p in to(o, t):
                    if o in life and p in life:
                        (a, b), (c, e) = life[o], life[p]
                        total, d, i = total + 1, d + (c <= a <= b <= e), i + (b <= c or a < c <= b < e)
                if to(o, t):
                    signatures[tuple(sorted(len(to(p, s)) for p in to(o, t)))] += 1
            time[s, t] = total, d, i
            card[s, t] = max(signatures.values(), default=0)
            inter[s, t] = sum(bool(to(o, t)) for o in members[s])
            sets = defaultdict(set)
            for e, activity, _ in events:
                partners = frozenset(p for p in own[e] if objects[p] == t)
                for o in own[e]:
                    if objects[o] == s and partners:
                        sets[activity, o].add(partners)
            div[s, t] = len({p for x in sets.values() for p in frozenset.union(*x) - frozenset.intersection(*x)})
    result = {}
    for s in types:
        for t in types:
            if s == t:
                result[s, t] = (0, 0)
                continue
            n, m = len(members[s]), len(members[t])
            total = time[s, t][0]
            push = (time[t, s][1] - time[s, t][1]) / total if total else 0
            pull = (time[t, s][2] + time[s, t][2]) / total if total else 0
            push += (n - card[s, t]) / n - (m - card[t, s]) / m
            pull += (card[s, t] + card[t, s]) / (n + m)
            r, q = div[s, t] / m, div[t, s] / n
            push, pull = push + r - q, pull + (1 - r) * (1 - q) * max(inter[s, t] / n, inter[t, s] / m)
            result[s, t] = push / 3, pull / 3
    return result


@pytest.mark.parametrize("seed", range(4))
def test_scores(spark, seed):
    raw = random_log(seed)
    got = {(r.source_type, r.target_type): (r.push, r.pull) for r in scores.score_matrix(frames(spark, *raw)).collect()}
    expected = naive_scores(*raw)
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v), k


def test_weights_and_own_scorers(spark):
    log = frames(spark, *random_log(1)).keep()

    class Fixed:
        weight = 3

        def scores(self, log):
            return log.events.sparkSession.createDataFrame([("x", "y", 0.5, 0.25)], "source_type string, target_type string, push double, pull double")

    time = {(r.source_type, r.target_type): r for r in scores.TimeScorer().scores(log).collect()}
    got = {(r.source_type, r.target_type): r for r in scores.score_matrix(log, [scores.TimeScorer(1), Fixed()]).collect()}
    assert got["x", "y"].push == pytest.approx((time["x", "y"].push + 1.5) / 4)
    assert got["y", "x"].pull == pytest.approx(time["y", "x"].pull / 4)
    with pytest.raises(ValueError):
        scores.score_matrix(log, [])
    log.release()


def test_declared_types(spark):
    events, objects, e2o = [("e", "do", None)], [("a", "x"), ("b", "y"), ("c", "idle"), ("d", "idle")], [("e", "a"), ("e", "b")]
    tables = (
        spark.createDataFrame(events, "eid string, activity string, ts timestamp"),
        spark.createDataFrame(objects, "oid string, otype string"),
        spark.createDataFrame(e2o, "eid string, oid string"),
    )
    usual, whole = Log.from_tables(*tables), Log.from_tables(*tables, declared_types=True)
    assert usual.object_types == ["x", "y"] and whole.object_types == ["idle", "x", "y"]
    few, many = ({(r.source_type, r.target_type): (r.push, r.pull) for r in scores.score_matrix(log).collect()} for log in (usual, whole))
    assert len(few) == 4 and len(many) == 9 and few.items() <= many.items()
    assert {v for k, v in many.items() if "idle" in k} == {(0.0, 0.0)}


def test_from_tables_checks_columns(spark):
    frame = spark.createDataFrame([("a", "b")], "eid string, x string")
    with pytest.raises(ValueError, match="activity"):
        Log.from_tables(frame, frame, frame)


def test_star_schema_layers_and_models(spark, tmp_path):
    analysis = Discovery(order_to_cash(spark, SF))
    assert analysis.get_layers() == {"item": 1, "order": 2, "customer": 3, "part": 3, "supplier": 4}
    push, pull = analysis.scores_push, analysis.scores_pull
    for pair, values in {("customer", "item"): (0.6379, 0.0408), ("order", "item"): (0.6006, 0.0893), ("supplier", "part"): (0.4515, 0.2205), ("customer", "part"): (0, 0)}.items():
        assert (round(push[pair], 4), round(pull[pair], 4)) == values
        assert push[pair] == -push[pair[::-1]] and pull[pair] == pull[pair[::-1]]
    with pytest.raises(ValueError):
        analysis.discover_models([1])
    models = analysis.discover_models([0, 1, 2, 3])
    assert analysis.activity_to_layer == {"place_order": 1, "ship_item": 1, "return_item": 1}
    assert models[2].activities == ["place_order", "return_item", "ship_item"][:0] + sorted({"place_order", "ship_item"}) and models[2].highlighted == ["place_order", "ship_item"]
    assert models[1].resources["place_order"] == ["customer", "order"]
    assert models[2].fragments and models[3].net is not None
    page = analysis.visualize(output_path=tmp_path / "a" / "page.html")
    assert (tmp_path / "a" / "page.html").read_text() == page and "digraph ocpn" in page
    assert "Layer 4" in analysis.visualize_layers()
    text = format_matrices(push, pull)
    assert "0.6379" in text and text.count("\n\n") == 1
    analysis.log.release()


def test_models_need_layers(spark):
    with pytest.raises(ValueError, match="layers"):
        Discovery(frames(spark, *random_log(0))).discover_models()


def test_format_matrices_checks_its_input():
    with pytest.raises(TypeError):
        format_matrices([], {})
    with pytest.raises(ValueError):
        format_matrices({"ab": 1.0}, {})


def test_context():
    assert sublog.normalise_context([1, 2], None) == {1: 1, 2: 1}
    assert sublog.normalise_context([1, 3], [0, 2]) == {1: 0, 3: 2}
    for bad in ([1], [1, -1], [True, 1], [1, 1.5]):
        with pytest.raises(ValueError):
            sublog.normalise_context([1, 2], bad)


def test_flows_order_ties_and_missing_times(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [(1, "e2", "b", t, "o", "x"), (1, "e1", "a", t, "o", "x"), (1, "e0", "late", None, "o", "x")]
    frame = spark.createDataFrame(rows, "layer int, eid string, activity string, ts timestamp_ntz, oid string, otype string")
    assert [list(r.trace) for r in flows.object_variants(frame).collect()] == [["a", "b", "late"]]
    assert {(r.activity, r.follower) for r in flows.directly_follows(frame).collect()} == {("a", "b"), ("b", "late")}
    assert {(r.activity, r.starts, r.ends) for r in flows.start_end_activities(frame).collect()} == {("a", 1, 0), ("late", 0, 1)}


@pytest.mark.parametrize("busy", [0, 3, 100_000])
def test_followers_of_busy_objects(spark, busy):
    rng = random.Random(4)
    rows = [(1, f"o{rng.randint(0, 3)}", "x", f"e{k:03}", rng.choice("abc"), dt.datetime(2020, rng.randint(1, 5), rng.randint(1, 3)) if rng.random() < 0.9 else None) for k in range(120)]
    frame = spark.createDataFrame(rows, "layer int, oid string, otype string, eid string, activity string, ts timestamp_ntz")
    traces = defaultdict(list)
    for _, oid, _, eid, activity, ts in sorted(rows, key=lambda r: (r[5] is None, r[5] or dt.datetime.min, r[3])):
        traces[oid].append(activity)
    expected = Counter(pair for t in traces.values() for pair in zip(t, t[1:]))
    assert {(r.activity, r.follower): r.n for r in flows.directly_follows(frame, busy).collect()} == expected


def test_layer_sink(spark, tmp_path):
    raw = random_log(2)
    log = frames(spark, *raw)
    logs = sublog.LayerLogs(log, sublog.layer_frame(spark, {"x": 1, "y": 2, "z": 2}))
    logs.write(str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/events").count() == logs.events().count()
    assert {r.layer for r in spark.read.parquet(f"{tmp_path}/objects").select("layer").distinct().collect()} <= {1, 2}

"""Every operator as a query over the star-schema tables, and the same query in SQL.

The SQL is put together from named common table expressions; each names those it reads.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .framework import discover_nets, matrices
from .log import Log
from .operators import flows, relations, scores, sublog
from .plans import fragments, layers, net
from .sources.star import conversations, event_table, order_to_cash

Query = Callable[[SparkSession, str], DataFrame]

_solutions: dict[tuple, dict[str, int]] = {}


def _snapshot(spark: SparkSession, sf_dir: str) -> tuple:
    """Paths, sizes and times of the files that a log is derived from: new data under an old path is another snapshot."""
    paths = [f"{sf_dir}/{t}.parquet" for t in ("orders", "lineitem", "customer", "part", "supplier", "nation")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", F.col("modificationTime").cast("string"))
    return tuple(sorted(map(tuple, files.collect())))


def forget() -> None:
    """Solve anew, as in a new application."""
    _solutions.clear()


def _solution(log: Log, name: str, sf_dir: str) -> dict[str, int]:
    """Layers of a log, kept per application and snapshot of its files: as many entries as the log has types."""
    spark = log.events.sparkSession
    key = (spark.sparkContext.applicationId, name, _snapshot(spark, sf_dir))
    if key not in _solutions:
        push, pull = matrices(_matrix(log))
        _solutions[key] = layers.solve(sorted({a for a, _ in push}), push, pull)
    return _solutions[key]


def _layer_logs(spark: SparkSession, sf_dir: str, explicit: bool = False, context: int = 1) -> sublog.LayerLogs:
    log = order_to_cash(spark, sf_dir, explicit_edges=explicit)
    found = _solution(log, f"explicit={explicit}", sf_dir)
    return sublog.LayerLogs(log, sublog.layer_frame(spark, found), dict.fromkeys(found.values(), context))


def _text(column: str):
    return F.col(column).cast("string").alias(column)


def _of_log(make: Callable[[Log], DataFrame], **how) -> Query:
    return lambda spark, sf_dir: make(order_to_cash(spark, sf_dir, **how))


def _of_layers(make: Callable[[sublog.LayerLogs], DataFrame], explicit: bool = False, context: int = 1) -> Query:
    return lambda spark, sf_dir: make(_layer_logs(spark, sf_dir, explicit, context))


def _lifespan(log: Log) -> DataFrame:
    return log.lifespan.select("oid", _text("t_min"), _text("t_max"))


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layer_logs(spark, sf_dir).layers


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _layer_logs(spark, sf_dir)
    levels = {r[0]: r[1] for r in logs.activity_layer().collect()}
    rows = []
    for layer, model in sorted(discover_nets(logs.relations()).items()):
        merged = net.merge(model)
        for f in fragments.detect(model, levels, layer):
            rows.append((layer, f.id, f.color, list(f.object_types), [x.get("label") or x["name"] for x in f.record(merged)["transitions"]], len(f.places), len(f.arcs)))
    return spark.createDataFrame(rows, "layer int, id string, color string, object_types array<string>, transitions array<string>, places int, arcs int")


def _mined(spark: SparkSession, sf_dir: str, rows: Callable, schema: str) -> DataFrame:
    """Rows of each layer's mined net; nets have as many nodes as a process has activities."""
    logs = _layer_logs(spark, sf_dir)
    levels = {r[0]: r[1] for r in logs.activity_layer().collect()}
    return spark.createDataFrame([row for layer, model in sorted(discover_nets(logs.relations()).items()) for row in rows(layer, net.merge(model), levels)], schema)


def _mined_places(layer: int, merged: net.Merged, levels: dict[str, int]):
    for otype in sorted({p[1] for p in merged.places}):
        for place, onward in merged.place_graph(otype).items():
            yield from ((layer, otype, place[2], q[2]) for q in sorted(onward))


def _mined_parts(layer: int, merged: net.Merged, levels: dict[str, int]):
    for part in fragments.linked(merged, fragments.candidates(merged, levels, layer)):
        names = sorted(map(net.node_name, part))
        yield from ((layer, name, names[0]) for name in names)


#: Small nets of every shape that the fragment rules tell apart, with the activities inside: (nets by type, inside).
FRAGMENT_NETS: dict[str, tuple[dict[str, net.Net], str]] = {
    "two_types": (
        {
            "parcel": net.from_chains("p0>open>p1>fill>p2>seal>p3>send>p4", activities=("open", "fill", "seal", "send")),
            "truck": net.from_chains("t0>come>t1>fill>t2>go>t3", activities=("come", "fill", "go")),
        },
        "fill seal",
    ),
    "from_the_start": ({"x": net.from_chains("s>a>m>b>e>c>f", activities="abc")}, "a b"),
    "to_the_end": ({"x": net.from_chains("s>c>m>a>n>b>e", activities="abc")}, "a b"),
    "way_around": ({"x": net.from_chains("s>a>m>b>e", "s>c>n>d>e", activities="abcd")}, "a b"),
    "way_in_between": ({"x": net.from_chains("s>a>m>b>e", "s>c>n>d>k", "k>f>e", activities="abcdf")}, "a b f"),
    "apart": ({"x": net.from_chains("s>c>m>a>n>d>e", "u>f>v>b>w>g>z", activities="abcdfg")}, "a b"),
    "two_ends": ({"x": net.from_chains("s>c>m>a>n>b>k>d>e", "a>z", activities="abcd")}, "a b"),
    "silent_skip": ({"x": net.from_chains("s>c>m>a>n>b>k>d>e", "m>skip>n", activities="abcd", silent=("skip",))}, "a b"),
    "loop": ({"x": net.from_chains("s>c>m>a>n>b>k>d>e", "n>redo>m", activities="abcd", silent=("redo",))}, "a b"),
    "loop_outside": ({"x": net.from_chains("s>a>m>b>e", "e>c>s", activities="abc")}, "a b"),
    "parallel": ({"x": net.from_chains("s>split>l>a>m>join>e", "split>r>b>n>join", activities="ab", silent=("split", "join"))}, "a b"),
    "half_of_parallel": ({"x": net.from_chains("s>split>l>a>m>join>e", "split>r>b>n>join", activities="ab", silent=("split", "join"))}, "a"),
    "second_type_breaks": (
        {
            "x": net.from_chains("s>a>m>b>n>d>e", activities="abd"),
            "y": net.from_chains("u>a>v>c>w>b>z", activities="abc"),
        },
        "a b d",
    ),
    "all_of_it": ({"x": net.from_chains("s>a>m>b>n>d>e", activities="abd"), "y": net.from_chains("u>a>v>b>z", activities="ab")}, "a b d"),
    "rival_choices": ({"x": net.from_chains("s>a>m>b>n>d>e", "m>c>e", activities="abcd")}, "a b d"),
}


def _net_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of the fixed nets; no table is read."""
    rows = []
    for name, (nets, inside) in FRAGMENT_NETS.items():
        for f in fragments.detect(net.OCNet(nets), dict.fromkeys(inside.split(), 1), 2):
            rows.append((name, ",".join(f.object_types), ",".join(sorted(map(net.node_name, f.transitions))), len(f.places), len(f.arcs)))
    return spark.createDataFrame(rows, "net string, object_types string, transitions string, places int, arcs int")


def _matrix(log: Log) -> DataFrame:
    """Several scorers read the same relations, so those are kept while the matrix (types squared) is made, and dropped again."""
    rows = scores.score_matrix(log.keep(), settle=bool(log.plans))
    found = log.events.sparkSession.createDataFrame(rows.collect(), rows.schema)
    log.release()
    return found


def _small_log(make: Callable[[SparkSession, str], Log]) -> Query:
    return lambda spark, sf_dir: _matrix(make(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "events_log": _of_log(lambda log: log.events.select("eid", "activity", _text("ts"))),
    "e2o": _of_log(lambda log: log.e2o),
    "objects_by_type": _of_log(lambda log: log.typed.groupBy("eid", "otype").agg(F.count(F.lit(1)).alias("objects"))),
    "participants": _of_log(lambda log: log.participants),
    "type_population": _of_log(lambda log: relations.type_population(log.participants)),
    "lifespan": _of_log(_lifespan),
    "lifespan_null_times": _of_log(_lifespan, null_times=True),
    "cooccurrence": _of_log(lambda log: log.cooccurrence),
    "explicit_edges": _of_log(lambda log: relations.explicit_edges(log.o2o, log.participants), explicit_edges=True),
    "related_counts": _of_log(lambda log: relations.related_counts(log.degree_totals)),
    "related_counts_explicit": _of_log(lambda log: relations.related_counts(log.degree_totals), explicit_edges=True),
    "time_counters": _of_log(scores.time_counters),
    "time_counters_null_times": _of_log(scores.time_counters, null_times=True),
    "time_scores": _of_log(lambda log: scores.TimeScorer().scores(log)),
    "degrees": _of_log(lambda log: log.degrees),
    "bilateral_signatures": _of_log(scores.bilateral_signatures),
    "dominant_signature": _of_log(scores.dominant_signature),
    "cardinality_scores": _of_log(lambda log: scores.CardinalityScorer().scores(log)),
    "diverging_targets": _of_log(scores.diverging_targets),
    "divergence_ratio": _of_log(scores.divergence_ratio),
    "interaction_counts": _of_log(scores.interaction_counts),
    "divergence_scores": _of_log(lambda log: scores.DivergenceScorer().scores(log)),
    "score_matrix": _of_log(_matrix),
    "score_matrix_explicit": _of_log(_matrix, explicit_edges=True),
    "score_matrix_pivot": _of_log(lambda log: scores.score_matrix_pivot(_matrix(log))),
    "event_table_scores": _small_log(event_table),
    "conversation_scores": _small_log(conversations),
    "layers": _layers,
    "layer_types": lambda spark, sf_dir: sublog.layer_types(_layers(spark, sf_dir)),
    "activity_layer": _of_layers(lambda x: x.activity_layer()),
    "layer_activities": _of_layers(lambda x: x.layer_activities()),
    "layer_events": _of_layers(lambda x: x.events().select("layer", "eid", "activity", _text("ts"))),
    "layer_relations": _of_layers(lambda x: x.relations().select("layer", "eid", "oid", "otype")),
    "layer_objects": _of_layers(lambda x: x.objects()),
    "layer_o2o": _of_layers(lambda x: x.edges(), explicit=True, context=3),
    "layer_objects_context": _of_layers(lambda x: x.objects(), context=3),
    "activity_resources_context": _of_layers(lambda x: x.activity_resources().select("layer", "activity", F.array_join("resources", ",").alias("resources")), context=3),
    "activity_resources": _of_layers(lambda x: x.activity_resources().select("layer", "activity", F.array_join("resources", ",").alias("resources"))),
    "highlighted_activities": _of_layers(lambda x: x.highlighted_activities()),
    "object_variants": _of_layers(lambda x: flows.object_variants(x.relations()).select("layer", "otype", F.array_join("trace", ",").alias("trace"), "objects")),
    "dfg": _of_layers(lambda x: flows.directly_follows(x.relations())),
    "start_end_activities": _of_layers(lambda x: flows.start_end_activities(x.relations())),
    "arc_multiplicity": _of_layers(lambda x: x.arc_multiplicity()),
    "place_graph": _of_layers(lambda x: flows.place_graph(flows.flow_net(x.relations()))),
    "candidate_components": _of_layers(lambda x: flows.candidate_components(flows.flow_net(x.relations()), x.activity_layer())),
    "net_arcs": lambda spark, sf_dir: net.net_arcs(spark, sorted(discover_nets(_layer_logs(spark, sf_dir).relations()).items())),
    "mined_place_graph": lambda spark, sf_dir: _mined(spark, sf_dir, _mined_places, "layer int, otype string, place string, successor string"),
    "mined_components": lambda spark, sf_dir: _mined(spark, sf_dir, _mined_parts, "layer int, transition string, component string"),
    "subprocess_fragments": _fragments,
    "net_fragments": _net_fragments,
}

# The same in SQL.


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x).lower() if isinstance(x, bool) else f"'{x}'" for x in row) + ")" for row in rows)


def _fixed_arcs():
    """net, otype, place, transition, whether the transition fills the place."""
    for name, (nets, _) in FRAGMENT_NETS.items():
        for otype, one in nets.items():
            for a, b in one.arcs:
                made = a in one.transitions
                place, transition = (b, a) if made else (a, b)
                yield name, otype, place, net.node_name(net.transition_key(otype, transition, one.transitions[transition])), made


def _fixed_inside():
    for name, (nets, inside) in FRAGMENT_NETS.items():
        yield from ((name, x) for x in inside.split())
        yield from ((name, f"{otype}/{t}") for otype, one in nets.items() for t, label in one.transitions.items() if label is None)


#: Feasible sets by trying every set of transitions inside: f_set is all of them, as bit masks.
_FRAGMENT_TABLES = {
    "f_arc": f"SELECT * FROM (VALUES {_values(_fixed_arcs())}) v(net, otype, place, t, made)",
    "f_in": f"SELECT * FROM (VALUES {_values(_fixed_inside())}) v(net, t)",
    "f_bit": "SELECT net, t, CAST(row_number() OVER (PARTITION BY net ORDER BY t) - 1 AS INTEGER) AS bit FROM f_in",
    "f_set": "SELECT net, CAST(r.range AS INTEGER) AS mask FROM (SELECT net, count(*) AS n FROM f_bit GROUP BY net) b JOIN range(1, 256) r ON r.range < pow(2, n)",
    "f_member": "SELECT s.net, mask, t FROM f_set s JOIN f_bit b ON b.net = s.net AND (mask >> bit) & 1 = 1",
    "f_whole": "SELECT net, otype, place, count(DISTINCT t) AS n FROM f_arc GROUP BY net, otype, place",
    "f_touch": """SELECT m.net, mask, a.otype, a.place, bool_or(made) AS fed, bool_or(NOT made) AS drawn, count(DISTINCT m.t) AS n
        FROM f_member m JOIN f_arc a ON a.net = m.net AND a.t = m.t GROUP BY m.net, mask, a.otype, a.place""",
    "f_type": """SELECT net, mask, otype, count(*) FILTER (WHERE NOT fed) AS ins, count(*) FILTER (WHERE NOT drawn) AS outs,
        min(place) FILTER (WHERE NOT fed) AS entry, min(place) FILTER (WHERE NOT drawn) AS leave FROM f_touch GROUP BY net, mask, otype""",
    "f_hop": "SELECT DISTINCT a.net, a.otype, a.t, a.place AS p, b.place AS q FROM f_arc a JOIN f_arc b ON a.net = b.net AND a.otype = b.otype AND a.t = b.t AND b.made AND NOT a.made",
    "f_way": """SELECT net, mask, otype, place AS p, place AS q FROM f_touch
        UNION SELECT w.net, w.mask, w.otype, w.p, h.q FROM f_way w JOIN f_hop h ON h.net = w.net AND h.otype = w.otype AND h.p = w.q JOIN f_member m ON m.net = w.net AND m.mask = w.mask AND m.t = h.t""",
    "f_walk": """SELECT net, mask, otype, leave, entry AS q, false AS own, false AS other FROM f_type WHERE ins = 1 AND outs = 1
        UNION SELECT w.net, w.mask, w.otype, w.leave, h.q, w.own OR (x.place IS NOT NULL AND h.q <> w.leave), w.other OR x.place IS NULL
        FROM f_walk w JOIN f_hop h ON h.net = w.net AND h.otype = w.otype AND h.p = w.q LEFT JOIN f_touch x ON x.net = w.net AND x.mask = w.mask AND x.otype = w.otype AND x.place = h.q""",
    "f_near": "SELECT DISTINCT a.net, a.t AS one, b.t AS two FROM f_arc a JOIN f_arc b ON a.net = b.net AND a.otype = b.otype AND a.place = b.place",
    "f_link": """SELECT net, mask, min(t) AS t FROM f_member GROUP BY net, mask
        UNION SELECT l.net, l.mask, m.t FROM f_link l JOIN f_near n ON n.net = l.net AND n.one = l.t JOIN f_member m ON m.net = l.net AND m.mask = l.mask AND m.t = n.two""",
    "f_bad": """SELECT x.net, x.mask FROM f_touch x JOIN f_whole w ON w.net = x.net AND w.otype = x.otype AND w.place = x.place WHERE fed AND drawn AND x.n < w.n
        UNION SELECT net, mask FROM f_type WHERE ins <> 1 OR outs <> 1
        UNION SELECT x.net, x.mask FROM f_touch x JOIN f_type k ON k.net = x.net AND k.mask = x.mask AND k.otype = x.otype
            LEFT JOIN f_way a ON a.net = x.net AND a.mask = x.mask AND a.otype = x.otype AND a.p = k.entry AND a.q = x.place
            LEFT JOIN f_way b ON b.net = x.net AND b.mask = x.mask AND b.otype = x.otype AND b.p = x.place AND b.q = k.leave WHERE a.p IS NULL OR b.p IS NULL
        UNION SELECT net, mask FROM f_walk WHERE q = leave AND own AND other
        UNION SELECT net, mask FROM f_link GROUP BY net, mask HAVING count(*) < bit_count(mask)""",
    "f_good": "SELECT s.net, s.mask FROM f_set s LEFT JOIN f_bad b ON b.net = s.net AND b.mask = s.mask WHERE b.mask IS NULL",
    "f_most": "SELECT a.net, a.mask FROM f_good a LEFT JOIN f_good b ON b.net = a.net AND b.mask <> a.mask AND b.mask & a.mask = a.mask WHERE b.mask IS NULL AND bit_count(a.mask) > 1",
}

_TABLES = _FRAGMENT_TABLES | {
    "item": "SELECT 'i:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS item, l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, min(l_shipdate) AS sd, max(l_returnflag) AS rf FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey",
    "ev": """SELECT 'po:' || o_orderkey AS eid, 'place_order' AS activity, o_orderdate AS ts FROM orders
        UNION ALL SELECT 'sh:' || item, 'ship_item', sd FROM item
        UNION ALL SELECT 'rt:' || item, 'return_item', sd + INTERVAL 30 DAY FROM item WHERE rf = 'R'""",
    "ev_null": "SELECT eid, activity, CASE WHEN activity = 'place_order' AND CAST(substr(eid, 4) AS BIGINT) % 97 = 0 THEN NULL ELSE ts END AS ts FROM ev",
    "rel": """SELECT 'po:' || o_orderkey AS eid, 'o:' || o_orderkey AS oid, 'order' AS otype FROM orders
        UNION SELECT 'po:' || o_orderkey, 'c:' || o_custkey, 'customer' FROM orders
        UNION SELECT 'po:' || ok, item, 'item' FROM item JOIN orders ON ok = o_orderkey
        UNION SELECT 'sh:' || item, item, 'item' FROM item
        UNION SELECT 'sh:' || item, 'o:' || ok, 'order' FROM item
        UNION SELECT 'sh:' || item, 'p:' || pk, 'part' FROM item
        UNION SELECT 'sh:' || item, 's:' || sk, 'supplier' FROM item
        UNION SELECT 'rt:' || item, item, 'item' FROM item WHERE rf = 'R'
        UNION SELECT 'rt:' || item, 'c:' || o_custkey, 'customer' FROM item JOIN orders ON ok = o_orderkey WHERE rf = 'R'""",
    "part_": "SELECT DISTINCT oid, otype FROM rel",
    "pop": "SELECT otype, count(*) AS population FROM part_ GROUP BY otype",
    "life": "SELECT oid, min(ts) AS t_min, max(ts) AS t_max FROM rel JOIN {ev} USING (eid) WHERE ts IS NOT NULL GROUP BY oid",
    "meet": """SELECT activity, a.oid AS src, a.otype AS stype, b.oid AS dst, b.otype AS dtype, count(*) AS k
        FROM rel a JOIN rel b ON a.eid = b.eid AND a.otype <> b.otype JOIN ev e ON e.eid = a.eid GROUP BY activity, a.oid, a.otype, b.oid, b.otype""",
    "edge": "SELECT DISTINCT 'c:' || o_custkey AS src, 'p:' || pk AS dst FROM item JOIN orders ON ok = o_orderkey WHERE rf = 'R' UNION SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM customer",
    "edge2": """SELECT src, a.otype AS stype, dst, b.otype AS dtype FROM edge JOIN part_ a ON a.oid = src JOIN part_ b ON b.oid = dst
        UNION SELECT dst, b.otype, src, a.otype FROM edge JOIN part_ a ON a.oid = src JOIN part_ b ON b.oid = dst""",
    "related_plain": "SELECT DISTINCT src, stype, dst, dtype FROM meet",
    "related_more": "SELECT src, stype, dst, dtype FROM meet UNION SELECT src, stype, dst, dtype FROM edge2 WHERE stype <> dtype",
    "pairs": "SELECT a.otype AS source_type, b.otype AS target_type, a.population AS n, b.population AS n_rev FROM pop a CROSS JOIN pop b",
    "tc": """SELECT stype AS source_type, dtype AS target_type, count(*) AS total,
            count(*) FILTER (WHERE t.t_min <= s.t_min AND s.t_max <= t.t_max) AS dependent,
            count(*) FILTER (WHERE s.t_max <= t.t_min OR (s.t_min < t.t_min AND t.t_min <= s.t_max AND s.t_max < t.t_max)) AS initiating
        FROM {related} JOIN life s ON s.oid = src JOIN life t ON t.oid = dst GROUP BY stype, dtype""",
    "ts_": """SELECT p.source_type, p.target_type, CASE WHEN p.source_type = p.target_type OR a.total IS NULL THEN 0e0 ELSE (coalesce(b.dependent, 0) - a.dependent) / a.total END AS push,
            CASE WHEN p.source_type = p.target_type OR a.total IS NULL THEN 0e0 ELSE (coalesce(b.initiating, 0) + a.initiating) / a.total END AS pull
        FROM pairs p LEFT JOIN tc a ON a.source_type = p.source_type AND a.target_type = p.target_type LEFT JOIN tc b ON b.source_type = p.target_type AND b.target_type = p.source_type""",
    "deg": "SELECT src, stype, dtype, count(*) AS degree FROM {related} GROUP BY src, stype, dtype",
    "runs": """SELECT r.src, r.stype, r.dtype, d.degree AS rev, count(*) AS n FROM {related} r JOIN deg d ON d.src = r.dst AND d.stype = r.dtype AND d.dtype = r.stype
        GROUP BY r.src, r.stype, r.dtype, d.degree""",
    "sig": "SELECT src, stype, dtype, CAST(sum(n) AS BIGINT) AS degree, string_agg(rev || 'x' || n, ',' ORDER BY rev) AS signature FROM runs GROUP BY src, stype, dtype",
    "sigmax": "SELECT stype, dtype, max(c) AS c FROM (SELECT stype, dtype, signature, count(*) AS c FROM sig GROUP BY stype, dtype, signature) GROUP BY stype, dtype",
    "dom": """SELECT source_type, target_type, n AS total, coalesce(c, 0) AS constant, n - coalesce(c, 0) AS other
        FROM pairs LEFT JOIN sigmax ON stype = source_type AND dtype = target_type WHERE source_type <> target_type""",
    "cs": """SELECT p.source_type, p.target_type, CASE WHEN a.total IS NULL THEN 0e0 ELSE a.other / a.total - b.other / b.total END AS push,
            CASE WHEN a.total IS NULL THEN 0e0 ELSE (a.constant + b.constant) / (a.total + b.total) END AS pull
        FROM pairs p LEFT JOIN dom a ON a.source_type = p.source_type AND a.target_type = p.target_type LEFT JOIN dom b ON b.source_type = p.target_type AND b.target_type = p.source_type""",
    "seen": """SELECT activity, a.oid AS src, t.otype AS dtype, count(*) AS n FROM rel a JOIN ev e ON e.eid = a.eid
        JOIN (SELECT DISTINCT eid, otype FROM rel) t ON t.eid = a.eid AND t.otype <> a.otype GROUP BY activity, a.oid, t.otype""",
    "div": "SELECT m.activity, m.src, m.stype, m.dst, m.dtype, m.k, s.n FROM meet m JOIN seen s ON s.activity = m.activity AND s.src = m.src AND s.dtype = m.dtype WHERE k < n",
    "divn": "SELECT stype, dtype, count(DISTINCT dst) AS diverging FROM div GROUP BY stype, dtype",
    "ratio": """SELECT source_type, target_type, coalesce(diverging, 0) AS diverging, n_rev AS population, coalesce(diverging, 0) / n_rev AS ratio
        FROM pairs LEFT JOIN divn ON stype = source_type AND dtype = target_type WHERE source_type <> target_type""",
    "inter": "SELECT stype AS source_type, dtype AS target_type, count(DISTINCT src) AS interacting FROM {related} GROUP BY stype, dtype",
    "ds": """SELECT p.source_type, p.target_type, CASE WHEN a.ratio IS NULL THEN 0e0 ELSE a.ratio - b.ratio END AS push,
            CASE WHEN a.ratio IS NULL THEN 0e0 ELSE (1 - a.ratio) * (1 - b.ratio) * greatest(coalesce(i.interacting, 0) / p.n, coalesce(j.interacting, 0) / p.n_rev) END AS pull
        FROM pairs p LEFT JOIN ratio a ON a.source_type = p.source_type AND a.target_type = p.target_type LEFT JOIN ratio b ON b.source_type = p.target_type AND b.target_type = p.source_type
        LEFT JOIN inter i ON i.source_type = p.source_type AND i.target_type = p.target_type LEFT JOIN inter j ON j.source_type = p.target_type AND j.target_type = p.source_type""",
    "matrix": """SELECT t.source_type, t.target_type, (t.push * 1e0 + c.push * 1e0 + d.push * 1e0) / 3e0 AS push, (t.pull * 1e0 + c.pull * 1e0 + d.pull * 1e0) / 3e0 AS pull
        FROM ts_ t JOIN cs c ON c.source_type = t.source_type AND c.target_type = t.target_type JOIN ds d ON d.source_type = t.source_type AND d.target_type = t.target_type""",
    "asg": "SELECT r.range AS id, otype, 1 + (r.range // CAST(pow(5, k) AS BIGINT)) % 5 AS z FROM range(3125) r, (SELECT otype, row_number() OVER (ORDER BY otype) - 1 AS k FROM pop)",
    "cost": """SELECT a.id, sum(CASE WHEN a.otype < b.otype THEN CAST(round(pull * 1e9) AS BIGINT) * abs(a.z - b.z) ELSE 0 END
            + CASE WHEN push > 0 THEN CAST(round(push * 1e9) AS BIGINT) * greatest(0, 1 - a.z + b.z) ELSE 0 END) AS cost
        FROM asg a JOIN asg b ON b.id = a.id AND b.otype <> a.otype JOIN matrix ON source_type = a.otype AND target_type = b.otype GROUP BY a.id""",
    "lay": "SELECT otype, CAST(min(z) AS INTEGER) AS layer FROM asg JOIN cost USING (id) WHERE cost = (SELECT min(cost) FROM cost) GROUP BY otype",
    "own": "SELECT eid, activity, ts, oid, otype, layer FROM rel JOIN ev USING (eid) JOIN lay USING (otype)",
    "al": "SELECT activity, min(layer) AS activity_layer FROM own GROUP BY activity",
    "la": "SELECT layer, activity, activity_layer FROM (SELECT DISTINCT layer FROM lay), al WHERE activity_layer <= layer AND layer - activity_layer <= {context}",
    "lr": "SELECT DISTINCT o.layer, eid, o.activity, ts, oid, otype FROM own o JOIN la ON la.layer = o.layer AND la.activity = o.activity",
    "le": "SELECT DISTINCT layer, eid, activity, ts FROM lr",
    "lo": "SELECT DISTINCT layer, oid, otype FROM lr",
    "higher": """SELECT le.layer, le.activity, o.otype, o.layer AS own, count(*) AS k FROM le JOIN (SELECT DISTINCT eid, otype, layer FROM own) o ON o.eid = le.eid AND o.layer > le.layer
        GROUP BY le.layer, le.activity, o.otype, o.layer""",
    "lan": "SELECT layer, activity, count(*) AS n FROM le GROUP BY layer, activity",
    "steps": "SELECT layer, otype, oid, activity, lead(activity) OVER w AS follower, row_number() OVER w AS pos FROM lr WINDOW w AS (PARTITION BY layer, otype, oid ORDER BY ts NULLS LAST, eid)",
    "df_": "SELECT layer, otype, activity, follower, count(*) AS n FROM steps WHERE follower IS NOT NULL GROUP BY layer, otype, activity, follower",
    "se": "SELECT layer, otype, activity, count(*) FILTER (WHERE pos = 1) AS starts, count(*) FILTER (WHERE follower IS NULL) AS ends FROM steps WHERE pos = 1 OR follower IS NULL GROUP BY layer, otype, activity",
    "arcs": """SELECT layer, otype, otype || ':' || activity || '>' || follower AS place, activity, false AS enters FROM df_
        UNION ALL SELECT layer, otype, otype || ':' || activity || '>' || follower, follower, true FROM df_
        UNION ALL SELECT layer, otype, otype || ':>' || activity, activity, true FROM se WHERE starts > 0
        UNION ALL SELECT layer, otype, otype || ':' || activity || '>', activity, false FROM se WHERE ends > 0""",
    "inside": "SELECT DISTINCT layer, place, activity FROM arcs JOIN al USING (activity) WHERE activity_layer < layer",
    "hop": "SELECT DISTINCT a.layer, a.activity AS one, b.activity AS two FROM inside a JOIN inside b ON a.layer = b.layer AND a.place = b.place",
    "reach": "SELECT layer, one, two FROM hop UNION SELECT r.layer, r.one, s.two FROM reach r JOIN hop s ON r.layer = s.layer AND r.two = s.one",
    # the general event table, and conversations
    "x_rel": """SELECT CAST(event_id AS VARCHAR) AS eid, event_type AS activity, ts, 'u:' || user_id AS oid, 'user' AS otype FROM events
        UNION SELECT CAST(event_id AS VARCHAR), event_type, ts, 'k:' || json_extract_string(props, '$.k'), 'key' FROM events""",
    "v_rel": """SELECT DISTINCT 't-' || conv_id || '-' || turn AS eid, role AS activity, TIMESTAMP '2000-01-01 00:00:00' + to_seconds(turn) AS ts, 'v:' || conv_id AS oid, 'conv' AS otype FROM conversations
        UNION SELECT DISTINCT 't-' || conv_id || '-' || turn, role, TIMESTAMP '2000-01-01 00:00:00' + to_seconds(turn), 'r:' || role, 'role' FROM conversations""",
}


def _sql(final: str, events: str = "ev", related: str = "related_plain", context: int = 1, **other: str) -> str:
    """The final query with the tables it needs, in order."""
    tables = {k: v.replace("{ev}", events).replace("{related}", related).replace("{context}", str(context)) for k, v in (_TABLES | other).items()}
    done: dict[str, str] = {}

    def need(text: str, own: str = "") -> None:
        for name in tables:
            if name != own and name not in done and re.search(rf"(?:FROM|JOIN|, )\s*{name}\b", text):
                need(tables[name], name)
                done[name] = tables[name]

    need(final)
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in done.items()) + "\n" + final


#: Logs whose events and relations come from one table.
_EVENTS = {"ev": "SELECT DISTINCT eid, activity, ts FROM {t}", "rel": "SELECT DISTINCT eid, oid, otype FROM {t} WHERE oid IS NOT NULL"}


def _other_log(table: str) -> dict[str, str]:
    return {k: v.format(t=table) for k, v in _EVENTS.items()}


_TYPES = ("customer", "item", "order", "part", "supplier")
_MATRIX = "SELECT source_type, target_type, push, pull FROM matrix"

_RESOURCES = """SELECT lan.layer, lan.activity, coalesce(string_agg(otype, ',' ORDER BY own DESC, otype) FILTER (WHERE 2 * k >= n), '') AS resources
    FROM lan LEFT JOIN higher ON higher.layer = lan.layer AND higher.activity = lan.activity GROUP BY lan.layer, lan.activity"""

ORACLE_SQL: dict[str, str] = {
    "events_log": _sql("SELECT eid, activity, CAST(ts AS VARCHAR) AS ts FROM ev"),
    "e2o": _sql("SELECT eid, oid FROM rel"),
    "objects_by_type": _sql("SELECT eid, otype, count(*) AS objects FROM rel GROUP BY eid, otype"),
    "participants": _sql("SELECT oid, otype FROM part_"),
    "type_population": _sql("SELECT otype, population FROM pop"),
    "lifespan": _sql("SELECT oid, CAST(t_min AS VARCHAR) AS t_min, CAST(t_max AS VARCHAR) AS t_max FROM life"),
    "lifespan_null_times": _sql("SELECT oid, CAST(t_min AS VARCHAR) AS t_min, CAST(t_max AS VARCHAR) AS t_max FROM life", events="ev_null"),
    "cooccurrence": _sql("SELECT DISTINCT a.oid AS src, a.otype AS stype, b.oid AS dst, b.otype AS dtype FROM rel a JOIN rel b ON a.eid = b.eid"),
    "explicit_edges": _sql("SELECT src, stype, dst, dtype FROM edge2"),
    "time_counters": _sql("SELECT source_type, target_type, total, dependent, initiating FROM tc"),
    "time_counters_null_times": _sql("SELECT source_type, target_type, total, dependent, initiating FROM tc", events="ev_null"),
    "time_scores": _sql("SELECT source_type, target_type, push, pull FROM ts_"),
    "degrees": _sql("SELECT src, stype, dtype, degree FROM deg"),
    "bilateral_signatures": _sql("SELECT src, stype, dtype, degree, signature FROM sig"),
    "dominant_signature": _sql("SELECT source_type, target_type, total, constant, other FROM dom"),
    "cardinality_scores": _sql("SELECT source_type, target_type, push, pull FROM cs"),
    "diverging_targets": _sql("SELECT activity, src, stype, dst, dtype, k, n FROM div"),
    "divergence_ratio": _sql("SELECT source_type, target_type, diverging, population, ratio FROM ratio"),
    "interaction_counts": _sql("SELECT source_type, target_type, interacting FROM inter"),
    "divergence_scores": _sql("SELECT source_type, target_type, push, pull FROM ds"),
    "score_matrix": _sql(_MATRIX),
    "score_matrix_explicit": _sql(_MATRIX, related="related_more"),
    "score_matrix_pivot": _sql("SELECT source_type, " + ", ".join(f"""max(CASE WHEN target_type = '{t}' THEN round(push, 4) END) AS "{t}" """ for t in _TYPES) + "FROM matrix GROUP BY source_type"),
    "event_table_scores": _sql(_MATRIX, **_other_log("x_rel")),
    "conversation_scores": _sql(_MATRIX, **_other_log("v_rel")),
    "layers": _sql("SELECT otype, layer FROM lay"),
    "layer_types": _sql("SELECT layer, string_agg(otype, ',' ORDER BY otype) AS types FROM lay GROUP BY layer"),
    "activity_layer": _sql("SELECT activity, activity_layer FROM al"),
    "layer_activities": _sql("SELECT layer, activity, activity_layer FROM la"),
    "layer_events": _sql("SELECT layer, eid, activity, CAST(ts AS VARCHAR) AS ts FROM le"),
    "layer_relations": _sql("SELECT layer, eid, oid, otype FROM lr"),
    "layer_objects": _sql("SELECT layer, oid, otype FROM lo"),
    "layer_o2o": _sql("SELECT a.layer, src, dst FROM edge JOIN lo a ON a.oid = src JOIN lo b ON b.oid = dst AND b.layer = a.layer", related="related_more", context=3),
    "layer_objects_context": _sql("SELECT layer, oid, otype FROM lo", context=3),
    "activity_resources": _sql(_RESOURCES),
    "activity_resources_context": _sql(_RESOURCES, context=3),
    "highlighted_activities": _sql("SELECT DISTINCT le.layer, le.activity FROM le JOIN al ON al.activity = le.activity WHERE activity_layer = le.layer - 1"),
    "object_variants": _sql("SELECT layer, otype, trace, count(*) AS objects FROM (SELECT layer, otype, oid, string_agg(activity, ',' ORDER BY pos) AS trace FROM steps GROUP BY layer, otype, oid) GROUP BY layer, otype, trace"),
    "dfg": _sql("SELECT layer, otype, activity, follower, n FROM df_"),
    "start_end_activities": _sql("SELECT layer, otype, activity, starts, ends FROM se"),
    "arc_multiplicity": _sql("""SELECT layer, otype, activity, count(*) AS events, count(*) FILTER (WHERE objects = 1) AS single, count(*) > count(*) FILTER (WHERE objects = 1) AS variable
        FROM (SELECT layer, otype, activity, eid, count(*) AS objects FROM lr GROUP BY layer, otype, activity, eid) GROUP BY layer, otype, activity"""),
    "place_graph": _sql("SELECT DISTINCT a.layer, a.otype, a.place, b.place AS successor FROM arcs a JOIN arcs b ON a.layer = b.layer AND a.otype = b.otype AND a.activity = b.activity WHERE a.enters AND NOT b.enters"),
    "net_fragments": _sql("""SELECT f.net, string_agg(DISTINCT a.otype, ',' ORDER BY a.otype) AS object_types, string_agg(DISTINCT m.t, ',' ORDER BY m.t) AS transitions,
        CAST(count(DISTINCT a.otype || '/' || a.place) AS INTEGER) AS places, CAST(count(*) AS INTEGER) AS arcs
        FROM f_most f JOIN f_member m ON m.net = f.net AND m.mask = f.mask JOIN f_arc a ON a.net = m.net AND a.t = m.t GROUP BY f.net, f.mask"""),
    "candidate_components": _sql("SELECT layer, one AS activity, min(two) AS component FROM reach GROUP BY layer, one"),
}
for _name, _related in (("related_counts", "related_plain"), ("related_counts_explicit", "related_more")):
    ORACLE_SQL[_name] = _sql(f"SELECT stype, dtype, count(*) AS pairs, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM {_related} GROUP BY stype, dtype")

"""Net discovery over distributed traces: the recursion of ``miner.mine``, one level of all sub-logs at a time.

A frame holds every sub-log's distinct traces under the sub-log's name.  Of each sub-log the driver sees its directly-follows graph, its starts and ends
and two flags (activities squared, whatever the number of traces), decides a cut, and the traces are split by array functions where they are.  How often
a trace occurs plays no part in the cuts, so traces are distinct at every level.  There is one path for few and for many traces.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import miner
from .miner import SILENT, Graph, Tree

#: A sub-log is named by the roads that lead to it: its root, then the number of each child.
_SEP = "/"


def _graphs(logs: DataFrame) -> dict[str, tuple[Graph, bool, bool]]:
    """Per sub-log its graph, whether it has an empty trace, and whether all its other traces have one activity."""
    flags = logs.groupBy("log").agg(F.bool_or(F.size("trace") == 0).alias("empty"), F.bool_and(F.size("trace") <= 1).alias("single"))
    full = logs.where(F.size("trace") > 0)
    # one kind of row for nodes, starts, ends and edges
    follows = F.transform(F.arrays_zip(F.slice("trace", F.lit(1), F.size("trace") - 1).alias("a"), F.slice("trace", F.lit(2), F.size("trace")).alias("b")), lambda x: F.struct(F.lit("edge").alias("kind"), x.getField("a").alias("a"), x.getField("b").alias("b")))
    one = lambda kind, at: F.array(F.struct(F.lit(kind).alias("kind"), F.element_at("trace", at).alias("a"), F.lit("").alias("b")))
    facts = full.select("log", F.explode(F.array_distinct(F.concat(one("start", 1), one("end", -1), follows))).alias("x")).select("log", "x.*").distinct()
    found: dict[str, dict[str, set]] = defaultdict(lambda: defaultdict(set))
    for r in facts.collect():
        found[r["log"]][r["kind"]].add((r["a"], r["b"]))
    out = {}
    for r in flags.collect():
        edges, (starts, ends) = found[r["log"]]["edge"], ({a for a, _ in found[r["log"]][k]} for k in ("start", "end"))
        nodes = {x for e in edges for x in e} | starts | ends
        out[r["log"]] = (Graph(frozenset(nodes), frozenset(edges), frozenset(starts), frozenset(ends)), r["empty"], r["single"])
    return out


def _decide(graph: Graph, empty: bool, single: bool) -> tuple:
    """("tree", tree) where the sub-log is done, else (kind of split, parts)."""
    if empty:
        return ("rest", ()) if graph.nodes else ("tree", SILENT)
    if len(graph.nodes) == 1:
        leaf = ("leaf", next(iter(graph.nodes)))
        return "tree", leaf if single else ("loop", (leaf, SILENT))
    for kind, cut in miner.CUTS:
        if parts := cut(graph):
            return kind, tuple(parts)
    if any((a, b) in graph.edges for a in graph.ends for b in graph.starts):
        return "rounds", ()
    return "tree", miner.flower(graph.nodes)


def _children(logs: DataFrame, decided: dict[str, tuple], graphs: dict[str, tuple]) -> DataFrame:
    """The distinct traces of all children."""
    rows = []
    for name, (kind, parts) in decided.items():
        if kind != "tree":
            graph = graphs[name][0]
            rows.append((name, kind, len(parts), {a: k for k, p in enumerate(parts) for a in p}, sorted(graph.starts), sorted(graph.ends)))
    plan = logs.sparkSession.createDataFrame(rows, "log string, kind string, parts int, part map<string,int>, starts array<string>, ends array<string>")
    # as many rows as sub-logs, each as large as its graph's nodes, which the driver holds anyway
    logs = logs.join(F.broadcast(plan), "log")
    trace = F.col("trace")
    part = lambda a: F.element_at("part", a)
    child = lambda k, t: F.struct(F.lit(k).cast("int").alias("k") if isinstance(k, int) else k.cast("int").alias("k"), t.alias("trace"))
    empty = F.slice(trace, 1, 0)
    numbers = F.sequence(F.lit(1), F.size(trace) - 1)

    def pieces(cut) -> Column:
        """The trace in consecutive pieces, cut before each position (from 1) where ``cut`` holds."""
        at = F.concat(F.array(F.lit(0)), F.when(F.size(trace) > 1, F.filter(numbers, cut)).otherwise(F.array().cast("array<int>")))
        return F.transform(at, lambda a, i: F.slice(trace, a + 1, F.coalesce(F.get(at, i + 1), F.size(trace)) - a))

    here, before = lambda i: F.get(trace, i), lambda i: F.get(trace, i - 1)
    by_part = pieces(lambda i: part(here(i)) != part(before(i)))
    loop = F.transform(by_part, lambda t: child(part(F.get(t, 0)), t))
    outside = F.exists(by_part, lambda t: part(F.get(t, 0)) != 0)
    # an empty body where a trace begins or ends with a redo part, or passes from one redo part to another
    bare = F.exists(
        F.sequence(F.lit(0), F.size(by_part)),
        lambda i: (F.coalesce(part(F.get(F.get(by_part, i - 1), 0)), F.lit(1)) != 0) & (F.coalesce(part(F.get(F.get(by_part, i), 0)), F.lit(1)) != 0),
    )
    loop = F.concat(loop, F.when(outside & bare, F.array(child(0, empty))).otherwise(F.slice(loop, 1, 0)))
    split = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: child(k, F.filter(trace, lambda a: part(a) == k)))
    rounds = F.transform(pieces(lambda i: F.array_contains("ends", before(i)) & F.array_contains("starts", here(i))), lambda t: child(0, t))
    none = F.slice(rounds, 1, 0)
    made = (
        F.when(F.col("kind") == "rest", F.when(F.size(trace) > 0, F.array(child(0, trace))).otherwise(none))
        .when(F.col("kind") == "xor", F.array(child(part(F.get(trace, 0)), trace)))
        .when(F.col("kind").isin("seq", "par"), split)
        .when(F.col("kind") == "loop", loop)
        .otherwise(rounds)
    )
    named = F.concat_ws(_SEP, "log", F.col("x.k").cast("string")).alias("log")
    return logs.select("log", F.explode(made).alias("x")).select(named, F.col("x.trace").alias("trace")).distinct()


def mine_all(traces: DataFrame) -> dict[str, Tree]:
    """Process trees of all logs in ``traces`` (log: its name, trace: array of activities); every tree accepts every trace of its log."""
    logs = traces.select("log", "trace").distinct().persist()
    decided: dict[str, tuple] = {}
    kept = [logs]
    while True:
        graphs = _graphs(logs)
        if not graphs:
            break
        now = {name: _decide(*found) for name, found in graphs.items()}
        decided |= now
        if all(kind == "tree" for kind, _ in now.values()):
            break
        logs = _children(logs, now, graphs).persist()
        kept.append(logs)
    for frame in kept:
        frame.unpersist()

    def tree(name: str) -> Tree:
        kind, parts = decided[name]
        if kind == "tree":
            return parts
        if kind == "rest":
            return ("xor", (SILENT, tree(f"{name}{_SEP}0")))
        if kind == "rounds":
            return ("loop", (tree(f"{name}{_SEP}0"), SILENT))
        return miner.joined(kind, [tree(f"{name}{_SEP}{k}") for k in range(len(parts))])

    return {name: tree(name) for name in decided if _SEP not in name}

"""The driver contract, with and without the optional subpackage; a few queries against SQL."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ROOT = Path(entry.__file__).parent


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT / "stratolog", tmp_path / "stratolog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'layers' in q and 'pipeline' not in q and not [k for k in q if k.startswith('op1')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})


def test_entry(spark):
    assert entry.entry(spark).count() == 25


def test_mined_graphs(spark):
    arcs = entry.queries()["net_arcs"](spark, SF).collect()
    into, out = {}, {}
    for r in arcs:
        t = (r.layer, r.otype, r.source if r.source_kind == "transition" else r.target)
        (out if r.source_kind == "transition" else into).setdefault(t, set()).add(r.target if r.source_kind == "transition" else r.source)
    expected = {(*t[:2], p, q) for t in into for p in into[t] for q in out.get(t, ())}
    got = entry.queries()["mined_place_graph"](spark, SF).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    levels = {r.activity: r.activity_layer for r in entry.queries()["activity_layer"](spark, SF).collect()}
    name = {(r.layer, r.otype, t): r.label or f"{r.otype}/{t}" for r in arcs for t in [r.source if r.source_kind == "transition" else r.target]}
    inside = {(t[0], n) for t, n in name.items() if levels.get(n, 0) < t[0]}
    near = {}
    for t in set(into) | set(out):
        for p in into.get(t, set()) | out.get(t, set()):
            near.setdefault((t[0], t[1], p), set()).add((t[0], name[t]))
    part = {x: x for x in inside}
    for _ in inside:
        for group in near.values():
            if own := group & inside:
                least = min(part[x] for x in own)
                part |= dict.fromkeys(own, least)
    got = entry.queries()["mined_components"](spark, SF).collect()
    assert {(r.layer, r.transition): r.component for r in got} == {x: y[1] for x, y in part.items()}


@pytest.mark.parametrize("name", ["type_population", "time_counters", "divergence_ratio", "layer_types", "arc_multiplicity", "net_fragments"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("orders", "lineitem", "customer", "supplier", "part", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    expected = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    rows = expected.fetchall()
    got = entry.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)

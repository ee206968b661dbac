"""The order-to-cash log's own plans against SQL on odd tables: repeated rows, lines without an order, parts that no table has, returns, missing keys and times."""

import datetime as dt
import random
import re

import pytest

import __spark_entry__ as entry
from stratolog.sources.orders import OrderPlans, _dealt


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng, folder = random.Random(7), str(tmp_path_factory.mktemp("odd"))
    day = lambda: dt.datetime(1995, 1, 1) + dt.timedelta(days=rng.randint(0, 90))
    orders = [(k, rng.randint(1, 5), day()) for k in range(1, 30)] + [(97, 2, day()), (194, 2, day())]
    orders += orders[:3] + [(4, 5, day()), (5, 1, day()), (40, 2, day())]
    lines = [(rng.randint(1, 32), n % 3, rng.randint(1, 9), rng.randint(1, 4), day(), rng.choice("RNA")) for n in range(90)]
    lines += lines[:4] + [(*lines[5][:4], day(), "R"), (97, 1, 3, 2, day(), "R")]
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        "lineitem": (lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp_ntz, l_returnflag string"),
        "customer": ([(k, 1) for k in range(1, 6)], "c_custkey long, c_nationkey int"),
        "part": ([(k,) for k in range(1, 8)] + [(1,)], "p_partkey long"),
        "supplier": ([(k,) for k in range(1, 4)], "s_suppkey long"),
        "nation": ([(1,)], "n_nationkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


CHECKED = [
    "lifespan",
    "lifespan_null_times",
    "bilateral_signatures",
    "cardinality_scores",
    "cooccurrence",
    "degrees",
    "divergence_ratio",
    "divergence_scores",
    "diverging_targets",
    "dominant_signature",
    "interaction_counts",
    "related_counts",
    "related_counts_explicit",
    "time_counters",
    "time_counters_null_times",
    "time_scores",
    "activity_resources",
    "activity_resources_context",
    "arc_multiplicity",
    "activity_layer",
    "candidate_components",
    "highlighted_activities",
    "layer_activities",
    "layer_events",
]


@pytest.mark.parametrize("name", CHECKED)
def test_odd_tables_against_sql(spark, odd, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("orders", "lineitem", "customer", "supplier", "part", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{odd}/{table}.parquet/*.parquet')")
    expected = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    rows = expected.fetchall()
    got = entry.queries()[name](spark, odd).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)


SETTLED = ["related_counts", "interaction_counts", "dominant_signature", "cardinality_scores", "divergence_scores", "time_counters_null_times", "time_scores", "activity_layer", "layer_activities", "arc_multiplicity", "activity_resources_context"]


@pytest.mark.parametrize("name", SETTLED)
def test_lines_are_dealt_for_one_count_at_a_time(spark, odd, name):
    """What comes back is made of counts, so that no plan holds all shuffles of the lines at once."""
    assert "parquet" not in entry.queries()[name](spark, odd)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["lifespan_null_times", "layer_events"])
def test_lines_are_dealt_once(spark, odd, name):
    """All that reads the lines reads the same columns, so that they are shuffled once."""
    plan = entry.queries()[name](spark, odd)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[(l_orderkey[^]]*)\]", plan)
    assert scans and len({re.sub(r"#\d+L?", "", x) for x in scans}) == 1


@pytest.mark.parametrize("name", ["lifespan_null_times", "layer_events"])
def test_orders_are_dealt_once_and_lines_packed(spark, odd, name):
    """The orders are shuffled once as well, lines as two numbers beside their order, and no row of a line is shuffled again for its part or supplier."""
    plan = entry.queries()[name](spark, odd)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[(o_orderkey[^]]*)\].*?DataFilters: \[(.*?)\]", plan)
    assert scans and len({re.sub(r"#\d+L?", "", str(x)) for x in scans}) == 1
    assert name == "layer_events" or "Generate" not in plan
    for above in re.split(r"FileScan parquet \[l_orderkey", plan)[:-1]:
        assert re.findall(r"Exchange hashpartitioning\((\w+)#", above)[-1] == "ok" and re.search(r"AS w#.*AS v#", above[above.rindex("Exchange") :])


def test_lines_that_do_not_fit_the_packed_form(spark, tmp_path):
    """Large and negative keys, times within a day, missing times and flags, unknown flags: they travel as they are, beside those that fit."""
    duckdb = pytest.importorskip("duckdb")
    rng, big = random.Random(3), [1, 2, 2**24, 2**32 - 1, 2**32, 2**62, -1]
    when = lambda: rng.choice([None, dt.datetime(1969, 12, 30), dt.datetime(1995, 1, rng.randint(1, 28)), dt.datetime(1995, 2, 3, 4, 5, 6, 789)])
    lines = [(rng.choice(big), rng.choice([-1, 0, 1, 127, 128, 2**31 - 1]), rng.choice(big), rng.choice(big), when(), rng.choice(["A", "N", "R", "S", "", None])) for _ in range(300)]
    lines += [(None, 1, 1, 1, when(), "R"), (1, None, 1, 1, when(), "R"), *lines[:20]]
    orders = [(k, c, when()) for k in (*big, 7, None) for c in (1, None, 2)]
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        "lineitem": (lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp_ntz, l_returnflag string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    expected = duckdb.connect().execute(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_shipdate), max(l_returnflag) FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')
        WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY ALL""").fetchall()
    plans = OrderPlans(spark, str(tmp_path))
    assert sorted(map(tuple, plans.lines.collect()), key=repr) == sorted(expected, key=repr)
    assert sorted(map(tuple, _dealt(plans._raw, "pk").select("ok", "ln", "pk", "sk", "sd", "rf").collect()), key=repr) == sorted(expected, key=repr)

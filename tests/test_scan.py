"""Running states and sums in blocks against a plain loop."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from glossa.operators import scan


def test_states_and_sums_against_a_loop(spark):
    rng = random.Random(8)
    rows = [(d, 3 * k, rng.random() < 0.1, rng.choice([None, None, None, f"v{k}"]), rng.randint(0, 3)) for d, n in ((1, 200), (2, 1), (3, 40), (None, 30)) for k in range(n)]
    expected, state, total = {}, defaultdict(lambda: None), defaultdict(int)
    for d, k, reset, value, n in rows:
        before = state[d]
        state[d] = value if reset else before if before is not None else value
        expected[d, k] = (before, state[d], total[d])
        total[d] += n
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "d int, k long, reset boolean, value string, n int").where("d is not null").repartition(5)
    for size in (1, 7, 1000):
        found = scan.running(table, ["d"], "k", {"s": (F.col("reset"), F.col("value"))}, {"t": F.col("n")}, size=size).collect()
        assert len(found) == 241
        assert all((r.s_before, r.s, r.t) == expected[r.d, r.k] for r in found)


def test_all_states_of_a_block_are_told_in_one_order(spark):
    rows = spark.range(3000).selectExpr("id % 3 as d", "id as k", "id % 7 = 0 as reset", "if(id % 5 = 0, id, null) as v", "id % 2 as n")
    found = scan.running(rows, ["d"], "k", {"a": (F.col("reset"), F.col("v")), "b": (F.col("n") == 1, F.col("v")), "last": (None, F.col("v"))}, size=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    tree = plan.split("== Initial Plan ==")[-1]
    # The rows for what leaves their blocks, the blocks, and the rows themselves: one order each.
    assert sum("- Sort [" in line for line in tree.splitlines()) <= 3
    state, seen = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.k):
        state[r.d] = r.v if r.v is not None else state.get(r.d)
        seen[r.d, r.k] = state[r.d]
    assert all(r["last"] == seen[r.d, r.k] for r in found.collect())

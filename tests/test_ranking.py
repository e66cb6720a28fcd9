"""Positions in a total order, and ranks built on them."""

import random

from cinelake.operators import fit
from cinelake.operators.ranking import positions


def test_positions_match_a_sort(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 0, 1, 2]), rng.choice([None, "a", "b", "é", "Z"]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, s string, i long").repartition(5)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode(), r[2]))
    got = sorted((r.position, r.k, r.s, r.i) for r in positions(df, ["k", "s", "i"], partitions=7).collect())
    assert got == [(n, *r) for n, r in enumerate(want)]


def test_positions_edges(spark):
    empty = spark.createDataFrame([], "a int, position long")
    assert positions(empty, ["a"], "at").collect() == []
    same = spark.createDataFrame([(1, 7)] * 500, "a int, _n int")
    assert sorted(r.at for r in positions(same, ["a"], "at", 6).collect()) == list(range(500))


def test_rank_label_of_many_tables_needs_no_window_over_a_table(spark):
    obs = spark.createDataFrame(
        [(t, f"c{c:03}", float((c * 7 + t) % 50)) for t in (1, 2) for c in range(200)] + [(None, "x", 1.0), (3, "n", None)],
        "table_id int, code string, value double")
    got = fit.rank_label(obs, 25.0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(table_id" not in plan
    for t in (1, 2):
        mine = sorted((r["mean"], r.code, r["rank"], r.label) for r in got.collect() if r.table_id == t)
        assert [r[2] for r in mine] == list(range(1, 201))
        zero = next(r[2] for r in mine if r[0] == 25.0)
        assert all(r[3] == r[2] - zero for r in mine)
    assert {(r.table_id, r["rank"], r.label) for r in got.collect() if r.code in ("x", "n")} == {(None, 1, None), (3, 1, None)}

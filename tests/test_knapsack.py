import itertools

import numpy as np
import pytest

from lumenspan.operators import knapsack as K
from lumenspan.operators.profiles import Profile

P = [Profile("a", 8, 16), Profile("b", 16, 32), Profile("c", 32, 64)]


def table(spark, u):
    return spark.createDataFrame(
        [(f"d{i:03d}", P[j].name, float(x)) for i, row in enumerate(u) for j, x in enumerate(row)],
        "docno string, profile string, utility double"
    )


@pytest.mark.parametrize("seed", range(6))
def test_solution_is_feasible_and_near_the_optimum(spark, seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 7))
    u = np.sort(rng.random((n, 3)).round(2), axis=1)
    budget = int(n * rng.integers(17, 60))
    r = K.solve(table(spark, u), P, budget)
    rows = r.assignments.collect()
    cost, value = sum(x["cost_bytes"] for x in rows), sum(x["utility"] for x in rows)
    assert len(rows) == n and cost == r.report["total_cost_bytes"] <= budget
    best = max(sum(u[i, k] for i, k in enumerate(c)) for c in itertools.product(range(3), repeat=n) if sum(P[k].cost_bytes for k in c) <= budget)
    assert best - 1 <= value <= best + 1e-9


def test_passes_over_the_table_and_arrays_agree(spark):
    rng = np.random.default_rng(11)
    u = np.sort(rng.random((25, 3)).round(2), axis=1)
    a, b = (K.solve(table(spark, u), P, 900, max_iter=12, local=n) for n in (K.LOCAL, 0))
    same = (
        "total_cost_bytes", "selected_candidate_origin", "num_upgrades", "num_downgrades", "search_iterations",
        "tolerance_reached", "lambda_star"
    )
    assert {k: a.report[k] for k in same} == {k: b.report[k] for k in same}
    assert sorted(
        map(tuple, a.assignments.select("docno", "profile").collect())
    ) == sorted(map(tuple, b.assignments.select("docno", "profile").collect()))


def test_utilities_that_nearly_tie_are_summed_alike(spark):
    """Sums that differ in the last digits decide alike in one task and in passes over the table."""
    rng = np.random.default_rng(5)
    u = np.sort(np.round(rng.random((20, 3)), 1) + rng.integers(0, 3, (20, 3)) * 1e-15, axis=1)
    a, b = (K.solve(table(spark, u), P, 700, max_iter=10, local=n) for n in (K.LOCAL, 0))
    assert a.report == b.report
    assert sorted(map(tuple, a.assignments.collect())) == sorted(map(tuple, b.assignments.collect()))


def test_strategies_can_be_replaced(spark):
    u = table(spark, [[0.1, 0.5, 0.9], [0.2, 0.3, 0.4], [0.0, 0.0, 0.7]])
    kept = K.Strategies(upgrade=lambda p, c: c)
    plain, none = K.solve(u, P, 150, local=0), K.solve(u, P, 150, by=kept)
    assert none.report["num_upgrades"] == 0 and none.report["total_utility"] <= plain.report["total_utility"]
    assert isinstance(K.strategies("lagrangian_dual"), K.Strategies)
    with pytest.raises(ValueError):
        K.strategies("greedy")


def test_moves_that_do_not_fit_are_skipped(spark):
    p = K.Problem(
        spark.createDataFrame([("x", [0.0, 0.1, 0.9]), ("y", [0.0, 0.2, 0.2]), ("z", [0.0, 0.1, 0.1])], "docno string, u array<double>"),
        ["a", "b", "c"], [16, 32, 64], 16 * 3 + 40, 3
    )
    taken, n, spent = K.upgrade_round(K.upgrade_moves(K.cheapest(p).chosen, p), 40)
    assert {r["docno"] for r in taken.collect()} == {"y", "z"} and (n, spent) == (2, 32)


def test_bad_problems(spark):
    u = table(spark, [[0.1, 0.2, 0.3]])
    with pytest.raises(K.InfeasibleError):
        K.build(u, P, 15)
    with pytest.raises(ValueError):
        K.build(u.where("profile <> 'b'"), P, 100)
    with pytest.raises(ValueError):
        K.build(u.union(u.limit(1)), P, 100)
    with pytest.raises(ValueError):
        K.build(u.withColumnRenamed("profile", "p").selectExpr("docno", "'q' AS profile", "utility"), P, 100)


def test_former_repair():
    rows = [("x", [0.1, 0.5, 0.6], 2), ("y", [0.0, 0.1, 0.9], 2)]
    out = K.repair_by_single_moves(rows, [16, 32, 64], ["a", "b", "c"], 96)
    assert [k for _, _, k in out] == [1, 2]


def test_kept_tables_can_be_released(spark):
    from lumenspan.sources import shared

    t = shared.kept(spark.range(3))
    assert t.count() == 3 and shared.release(spark) >= 1 and shared.release(spark) == 0

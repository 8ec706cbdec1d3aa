"""Generated equations: what is called unsolvable has no solution by the separable solver, and odd rows are handled."""

import pytest

from eqlake.functions import expressions as X
from eqlake.operators import generators


def rows(spark, *strategies):
    e = spark.createDataFrame([(1, 0.0, 1.0, 0.5, "own"), (2, -1.0, 1.0, 0.5, "own"), (3, None, 1.0, None, "own")], "id int, a double, b double, lambda_val double, kernel string")
    return generators.augmented(e, *strategies).collect()


def test_rows(spark):
    out = rows(spark, "eigenvalue_cases", "range_violation", "ill_posed", "resonance")
    count = {i: sum(r.id == i for r in out) for i in (1, 2, 3)}
    assert count == {1: 11, 2: 10, 3: 10}
    assert all(r.has_solution == (r.solution_type != "none") and r.augmented for r in out)
    with pytest.raises(ValueError):
        rows(spark, "other")


def test_singular(spark):
    for r in rows(spark, "eigenvalue_cases"):
        if r.id < 3 and r.augmentation_variant != "symmetric_kernel_eigenvalue":
            assert X.solve(r.kernel, r.f, r.lambda_val, r.a, r.b) is None


def test_own_sides_are_kept(spark):
    e = spark.createDataFrame([(1, "x**2", "x", 0.0, 1.0, 0.5)], "i int, f string, u string, a double, b double, lambda_val double")
    got = {r.augmentation_variant: r for r in generators.augmented(e, "divergent_kernel", "weakly_singular", "near_resonance").collect()}
    assert len(got) == 9 and got["cauchy_singularity"].f == got["power_law_kernel"].f == "x**2"
    assert got["power_law_kernel"].u == "x" and got["cauchy_singularity"].u == "" and got["very_near_eigenvalue"].f.startswith("sin(pi*x)")
    assert round(got["power_law_kernel"].lambda_val, 12) == 0.025 and got["constant_near_eigenvalue"].lambda_val == 1.05
    assert [r.f for r in generators.augmented(e.drop("f", "u"), "weakly_singular").collect()] == [None] * 3

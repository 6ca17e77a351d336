"""Draws by their moments and their sameness."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import draws


@pytest.mark.parametrize(("a", "b"), [(1.0, 1.0), (1.0, 9.0), (4.0, 2.0), (300.0, 500.0)])
def test_moments_of_beta_draws(spark, a, b):
    rows = spark.range(20_000).select(draws.beta_draw(F.lit(a), F.lit(b), F.concat_ws("|", F.lit("s"), "id")).alias("x")).collect()
    x = np.array([r["x"] for r in rows])
    mean, var = a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
    assert ((x > 0) & (x < 1)).all() and abs(x.mean() - mean) < 5 * np.sqrt(var / len(x)) and abs(x.var() / var - 1) < 0.08
    # the distribution of a uniform draw, by its deciles
    if a == b == 1:
        assert np.abs(np.quantile(x, np.arange(0.1, 1, 0.1)) - np.arange(0.1, 1, 0.1)).max() < 0.02


def test_draws_are_the_same_on_replay(spark):
    arms = spark.createDataFrame([(i, float(1 + i), 2.0) for i in range(40)] + [(99, None, 0.5)], "arm long, alpha double, beta double")
    cycles = arms.select("arm").crossJoin(spark.range(5).withColumnRenamed("id", "cycle"))
    one = {(r["cycle"], r["arm"]): r["draw"] for r in draws.bandit_draws(arms, cycles, "arm", "cycle").collect()}
    part = {(r["cycle"], r["arm"]): r["draw"] for r in draws.bandit_draws(arms.repartition(7), cycles.union(cycles).where("arm % 3 = 0 and cycle > 1"), "arm", "cycle").collect()}
    assert len(one) == 41 * 5 == len(set(one.values())) and part == {k: one[k] for k in part} and part
    other = draws.bandit_draws(arms, cycles, "arm", "cycle", seed="1").where("arm = 3 and cycle = 0").first()["draw"]
    assert other != one[0, 3]
    best = {r["cycle"]: r["arm"] for r in draws.winners(draws.bandit_draws(arms, cycles, "arm", "cycle"), "arm", "cycle").collect()}
    assert best == {c: max((a for k, a in one if k == c), key=lambda a, c=c: (one[c, a], -a)) for c in range(5)}
    ties = spark.createDataFrame([(0, 2, 0.5), (0, 1, 0.5), (1, 3, 0.1)], "cycle long, arm long, draw double")
    assert sorted(map(tuple, draws.winners(ties, "arm", "cycle").collect())) == [(0, 1, 0.5), (1, 3, 0.1)]

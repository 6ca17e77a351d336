"""Random draws that come out the same on every replay: uniforms from digests, gamma and beta draws as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.arrays import let

TRIES = 16


def uniform(seed: Column) -> Column:
    """A number within 0 and 1, neither of them, from the first 52 bits of the seed's MD5."""
    return (F.conv(F.substring(F.md5(seed), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def gamma_draw(shape: Column, seed: Column) -> Column:
    """A gamma draw of scale 1 for a shape of 1 or more, by the squeeze of a cubed normal (Marsaglia and Tsang, 2000).

    Each try takes three uniforms of the seed and the number of the try; under a twentieth of the tries fail, so all
    ``TRIES`` of them do in fewer than one of 10**20 draws, which are then the shape less a third.
    """

    def first(d: Column) -> Column:
        def attempt(i: Column) -> Column:
            u = [uniform(F.concat_ws("|", seed, i.cast("string"), F.lit(str(j)))) for j in range(3)]
            x = F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * F.pi() * u[1])
            trial = F.struct(x.alias("x"), F.pow(1 + x / F.sqrt(9 * d), F.lit(3.0)).alias("v"), F.ln(u[2]).alias("u"))
            return let(trial, lambda t: F.when((t["v"] > 0) & (t["u"] < 0.5 * t["x"] * t["x"] + d - d * t["v"] + d * F.ln(F.greatest(t["v"], F.lit(1e-300)))), d * t["v"]))

        # once a try has passed, the later ones are not worked out
        tries = F.sequence(F.lit(0), F.lit(TRIES - 1))
        return F.coalesce(F.aggregate(tries, F.lit(None).cast("double"), lambda got, i: F.when(got.isNotNull(), got).otherwise(attempt(i))), d)

    return let(shape - F.lit(1.0) / 3, first)


def beta_draw(alpha: Column, beta: Column, seed: Column) -> Column:
    """A beta draw for parameters of 1 or more; the same seed gives the same draw."""
    two = F.array(gamma_draw(alpha, F.concat_ws("|", seed, F.lit("a"))), gamma_draw(beta, F.concat_ws("|", seed, F.lit("b"))))
    return let(two, lambda g: F.get(g, 0) / (F.get(g, 0) + F.get(g, 1)))


def bandit_draws(arms: DataFrame, cycles: DataFrame, arm: str, cycle: str, seed: str = "0") -> DataFrame:
    """(cycle, arm, draw): a draw for each arm (with alpha and beta) in each cycle that lists it; null parameters count as 1.

    ``cycles`` has (cycle, arm). A draw depends on the seed, its cycle, its arm and its parameters alone, so a replay, or another
    set of arms, changes none of the others.
    """
    joined = cycles.select(cycle, arm).distinct().join(arms.select(arm, "alpha", "beta"), arm)
    own = F.concat_ws("|", F.lit(seed), F.col(cycle).cast("string"), F.col(arm).cast("string"))
    one = lambda c: F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(1.0)), F.lit(1.0))
    return joined.select(cycle, arm, beta_draw(one("alpha"), one("beta"), own).alias("draw"))


def winners(draws: DataFrame, arm: str, cycle: str) -> DataFrame:
    """(cycle, arm, draw) of the greatest draw of each cycle, the smaller arm of equals."""
    best = F.min(F.struct((-F.col("draw")).alias("less"), F.col(arm)))
    return draws.groupBy(cycle).agg(best.alias("b")).select(cycle, F.col(f"b.{arm}").alias(arm), (-F.col("b.less")).alias("draw"))

"""The status lattice as column expressions.

verified is above attributed and estimated, which are above unverified and have it as their meet; not_covered and then
contested absorb everything. A step down leaves the absorbing values and unverified where they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

V, A, E, U, N, C = "verified", "attributed", "estimated", "unverified", "not_covered", "contested"


def meet(x: Column, y: Column) -> Column:
    return (
        F.when((x == N) | (y == N), N).when((x == C) | (y == C), C)
        .when((x == y) | (y == V), x).when(x == V, y).otherwise(U)
    )


def step_down(x: Column) -> Column:
    return F.when(x.isin(N, C), x).when(x == V, A).otherwise(U)


def steps_down(x: Column, n: Column) -> Column:
    """n steps down at once: two reach the bottom from anywhere."""
    return F.when(n <= 0, x).when(n == 1, step_down(x)).otherwise(step_down(step_down(x)))


def worst(ranks: dict[str, int], values: Column, default: str) -> Column:
    """The value of the highest rank in an array; values of no rank count as the default."""
    table = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    back = F.create_map(*[F.lit(x) for k, r in ranks.items() for x in (r, k)])
    most = F.array_max(F.transform(values, lambda v: F.coalesce(table[v], F.lit(ranks[default]))))
    return F.coalesce(back[most], F.lit(default))


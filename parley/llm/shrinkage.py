"""Beta-binomial shrinkage shared by the operators on sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LEAST_RHO, MOST_RHO = 1e-4, 0.5


def strength(groups: DataFrame, hits: str, n: str, parent_mean: Column) -> float:
    """Prior strength of a level by moments: how much its rates vary beyond chance around their parents.

    In a beta-binomial group, n * (rate - mean)^2 is mean * (1 - mean) *
    (1 + (n - 1) * rho) on average; rho is estimated over all groups and kept in a
    sane range, and the strength is 1 / rho - 1. Without evidence it is that of the
    smallest rho.
    """
    spread = parent_mean * (1 - parent_mean)
    beyond = F.when(F.col(n) > 0, F.col(n) * F.pow(F.col(hits) / F.col(n) - parent_mean, 2) - spread)
    weight = F.when(F.col(n) > 1, (F.col(n) - 1) * spread)
    top, bottom = groups.agg(F.sum(beyond), F.sum(weight)).first()
    rho = (top or 0.0) / bottom if bottom else LEAST_RHO
    return 1 / min(max(rho, LEAST_RHO), MOST_RHO) - 1


def shrunk(hits: Column, n: Column, mean: Column, weight: float) -> Column:
    """Posterior mean of a rate under a beta prior of the given mean and strength."""
    return (hits + weight * mean) / (n + weight)

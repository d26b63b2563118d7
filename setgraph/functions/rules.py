"""Rules that operators take as parameters: edge weights of modularity, and infection through an edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Of an edge with d nodes, c of them in one part.


def linear(d: Column, c: Column) -> Column:
    """The share of the part if it is a majority, else 0."""
    return F.when(c > d / 2, c / d).otherwise(F.lit(0.0))


def majority(d: Column, c: Column) -> Column:
    """1 if the part is a majority, else 0."""
    return F.when(c > d / 2, F.lit(1.0)).otherwise(F.lit(0.0))


def strict(d: Column, c: Column) -> Column:
    """1 if the edge is within the part, else 0."""
    return F.when(c == d, F.lit(1.0)).otherwise(F.lit(0.0))


# Whether a susceptible node of an edge with `size` nodes, `infected` of the others infected, can be infected through it.


def collective_contagion(size: Column, infected: Column) -> Column:
    """If all others are infected."""
    return (infected == size - 1).cast("double")


def individual_contagion(size: Column, infected: Column) -> Column:
    """If any other is infected."""
    return (infected >= 1).cast("double")


def threshold(size: Column, infected: Column, tau: float = 0.1) -> Column:
    """If the share of infected others reaches tau; a node that is alone in the edge has share 0."""
    share = F.when(size > 1, infected / (size - 1)).otherwise(F.lit(0.0))
    return (share >= tau).cast("double")


def majority_vote(size: Column, infected: Column, seed: int = 0) -> Column:
    """If more than half of the others are infected; at exactly half by the toss of a coin."""
    share = F.when(size > 1, infected / (size - 1)).otherwise(F.lit(0.0))
    return F.when(share > 0.5, 1.0).when(share == 0.5, (F.rand(seed) < 0.5).cast("double")).otherwise(F.lit(0.0))

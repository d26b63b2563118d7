"""From any table to the library's three tables.

incidences: edge, node, weight, misc and any further columns, one row a pair. Properties: uid, weight, misc and any
further columns, one row an id.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SetGraphError
from ..functions.properties import aggregated, as_properties, no_properties

ORDER = "_ord"


def keep_first(df: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """The first row of each key by the order column, or by all columns where there is none."""
    comparable = [c for c, kind in df.dtypes if c not in keys and "map" not in kind and "variant" not in kind]
    maps = [F.to_json(c) for c, kind in df.dtypes if "map" in kind and "variant" not in kind]
    by = [F.col(order)] if order else [*map(F.col, comparable), *maps]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(by or [F.lit(0)])))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def normalise(
    df: DataFrame,
    columns: Mapping[str, str],
    weight_col: str | None = "weight",
    default_weight: float = 1.0,
    misc_col: str | None = None,
    aggregate_by: str | Callable | Mapping[str, str | Callable] = "first",
    order_col: str | None = None,
) -> DataFrame:
    """A table with the id columns of `columns` (new name: old name), weight, misc and the other columns.

    A null weight becomes the default; without a weight column the weight is the misc entry of that name, else the
    default. Rows with a null id are left out. Of repeated ids the first row stays, by order_col; another rule
    aggregates weights (a name) or columns by name (a mapping), and keeps the first value of the rest.
    """
    missing = [c for c in [*columns.values(), order_col] if c and c not in df.columns]
    if missing:
        raise SetGraphError(f"no such columns: {', '.join(missing)}")
    keys = list(columns)
    kinds = {f.name: f.dataType for f in df.schema}
    misc = as_properties(F.col(f"`{misc_col}`"), kinds[misc_col]) if misc_col in kinds else no_properties()
    if weight_col in kinds:
        weight = F.coalesce(F.col(f"`{weight_col}`").cast("double"), F.lit(float(default_weight)))
    else:
        weight = F.coalesce(F.try_element_at(misc, F.lit(weight_col or "weight")).cast("double"), F.lit(float(default_weight)))
    used = {*columns.values(), weight_col, misc_col, order_col}
    rest = [c for c in df.columns if c not in used and c not in (*keys, "weight", "misc", ORDER)]
    out = df.select(
        *(F.col(f"`{old}`").alias(new) for new, old in columns.items()),
        weight.alias("weight"),
        misc.alias("misc"),
        *(F.col(f"`{c}`") for c in rest),
        *([F.col(f"`{order_col}`").alias(ORDER)] if order_col else []),
    )
    for key in keys:
        out = out.filter(F.col(key).isNotNull())
    order = ORDER if order_col else None
    if aggregate_by == "first":
        return keep_first(out, keys, order).drop(ORDER)
    rules = {"weight": aggregate_by} if isinstance(aggregate_by, str) or callable(aggregate_by) else dict(aggregate_by)
    if set(rules) == {"weight"} and not rest and not misc_col:
        return aggregated(out, list(keys), rules, order).withColumn("weight", F.col("weight").cast("double")).withColumn("misc", no_properties())
    firsts = keep_first(out, keys, order).drop(ORDER, *rules)
    summed = aggregated(out, list(keys), rules, order)
    if "weight" in rules:
        summed = summed.withColumn("weight", F.col("weight").cast("double"))
    return firsts.join(summed, keys).select(*keys, "weight", "misc", *rest)

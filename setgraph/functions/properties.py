"""Properties of edges, nodes and incidences as maps and columns."""

from __future__ import annotations

import ast
import json
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = T.MapType(T.StringType(), T.StringType())


def no_properties() -> Column:
    return F.create_map().cast(STRINGS)


def encode_value(value) -> str | None:
    """A property value as text: strings as they are, all else as JSON."""
    return value if value is None or isinstance(value, str) else json.dumps(value, default=str)


def decode_value(text: str | None):
    """The value whose text this is; what isn't JSON is a string."""
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return text


@F.pandas_udf(STRINGS)
def _literal(texts: pd.Series) -> pd.Series:
    def read(text):
        try:
            value = ast.literal_eval(text)
        except (ValueError, SyntaxError, TypeError, MemoryError):
            return {}
        return {str(k): encode_value(v) for k, v in value.items()} if isinstance(value, dict) else {}

    return texts.map(read)


def as_properties(column: Column, kind: T.DataType) -> Column:
    """A column of maps, structs, or texts (JSON, or a Python literal) as a map of texts; anything else is empty."""
    if isinstance(kind, T.MapType):
        return F.coalesce(F.transform_values(column, lambda k, v: v.cast("string")), no_properties())
    if isinstance(kind, T.StructType):
        return F.coalesce(F.from_json(F.to_json(column), STRINGS), no_properties())
    if isinstance(kind, T.StringType):
        read = F.from_json(column, STRINGS)
        json_like = F.get_json_object(column, "$").isNotNull() & read.isNotNull()
        return F.when(column.isNull(), no_properties()).when(json_like, read).otherwise(_literal(column))
    return no_properties()


def upsert(old: Column, new: Mapping[str, object]) -> Column:
    """A map with entries of `new` put in place of entries of the same name."""
    if not new:
        return old
    entries = F.create_map(*(F.lit(x) for k, v in new.items() for x in (k, encode_value(v)))).cast(STRINGS)
    names = list(new)
    return F.map_concat(F.map_filter(old, lambda k, v: ~k.isin(names)), entries)


def merged(old: Column, new: Column) -> Column:
    """A map with all entries of both, those of `old` where both have one."""
    return F.map_concat(old, F.map_filter(new, lambda k, v: ~F.array_contains(F.map_keys(old), k)))


def flatten(nested: Mapping) -> dict:
    """A nested mapping as one level; of equal names the one met first stays. Empty mappings stay as values."""
    flat: dict = {}
    for name, value in nested.items():
        if isinstance(value, Mapping) and value:
            for inner, x in flatten(value).items():
                flat.setdefault(inner, x)
        else:
            flat.setdefault(name, value)
    return flat


#: Names of aggregations and how to express them; first and last go by the column named as order.
def aggregation(rule: str | Callable, column: str, order: str | None = None, kind: T.DataType | str | None = None) -> Column:
    """A column of an aggregation by a rule's name, or by a callable.

    A callable gets a key's values (nulls left out) as a pandas Series and returns one value of type kind: that of the
    values by default. It runs as a grouped-aggregate pandas UDF, so all values of one key meet in one task, and no part
    of them is aggregated before; for keys that hold a large part of all rows use a name. With `order` the values come
    in its order.
    """
    c = F.col(column)
    if callable(rule):
        return _called(rule, c, F.col(order) if order else None, kind or "double").alias(column)
    simple = {"sum": F.sum, "mean": F.avg, "avg": F.avg, "median": F.median, "max": F.max, "min": F.min, "count": F.count, "nunique": F.countDistinct, "std": F.stddev_samp, "var": F.var_samp, "list": F.collect_list}
    if rule in simple:
        return simple[rule](c).alias(column)
    if rule in ("first", "last"):
        by = F.col(order) if order else F.struct(c)
        return (F.min_by if rule == "first" else F.max_by)(c, by).alias(column)
    raise ValueError(f"unknown aggregation {rule!r}")


def _called(rule: Callable, column: Column, order: Column | None, kind: T.DataType | str) -> Column:
    """rule as a grouped-aggregate UDF of a column."""

    def call(values: pd.Series, places: pd.Series | None = None):
        if places is not None:
            values = values.iloc[places.argsort(kind="stable")]
        found = rule(values.dropna())
        return found.item() if hasattr(found, "item") else found

    if order is None:

        @F.pandas_udf(kind)
        def grouped(values: pd.Series) -> float:
            return call(values)

        return grouped(column)

    @F.pandas_udf(kind)
    def in_order(values: pd.Series, places: pd.Series) -> float:
        return call(values, places)

    return in_order(column, order)


def aggregated(df: DataFrame, keys: list[str], rules: Mapping[str, str | Callable], order: str | None = None) -> DataFrame:
    """keys (not null) and a column for each rule. Callables are grouped on their own, as they can't be partial, and joined."""
    named = {c: rule for c, rule in rules.items() if not callable(rule)}
    called = {c: rule for c, rule in rules.items() if callable(rule)}
    out = df.groupBy(*keys).agg(*(aggregation(rule, c, order) for c, rule in named.items())) if named or not called else None
    if called:
        placed = df
        if order is not None:
            placed = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
        values = placed.groupBy(*keys).agg(*(aggregation(rule, c, None if order is None else "_place", df.schema[c].dataType) for c, rule in called.items()))
        out = values if out is None else out.join(values, keys)
    return out.select(*keys, *rules)


def distinct_rows(rows: DataFrame, weights: str | None = None, aggregate_by: str | Callable | None = "sum", order: str | None = None) -> DataFrame:
    """Distinct rows over the columns other than `weights` (and `order`), with their weights aggregated by a rule.

    Without a weight column each row weighs 1. Rule None gives the distinct rows alone.
    """
    keys = [c for c in rows.columns if c not in (weights, order)]
    if aggregate_by is None:
        return rows.select(*keys).distinct()
    name = weights or "weight"
    weighed = rows if weights else rows.withColumn(name, F.lit(1.0))
    return weighed.groupBy(*keys).agg(aggregation(aggregate_by, name, order).alias(name))


def reversed_map(pairs: DataFrame, key: str = "key", values: str = "values") -> DataFrame:
    """From (key, array of values) the rows (value, sorted array of keys)."""
    flat = pairs.select(F.col(key).alias("_k"), F.explode(values).alias("value"))
    return flat.groupBy("value").agg(F.array_sort(F.collect_list("_k")).alias("keys"))

"""Tensors as long tables: one row per cell, integer axes, one value column.

A contraction is a join on the shared axes and a sum by the axes that remain. Small operands carry no hint:
the session's size threshold decides about broadcasting, and sums are partial before they are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contract(a: DataFrame, b: DataFrame, on: list[str], out: list[str], va: str = "v", vb: str = "v", name: str = "v") -> DataFrame:
    """out[...] = sum of a * b over all axes that are not in out."""
    x, y = a.withColumnRenamed(va, "_a"), b.withColumnRenamed(vb, "_b")
    return x.join(y, on).groupBy(*out).agg(F.sum(F.col("_a") * F.col("_b")).alias(name))


def gather(rows: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """Each row with the values at its index."""
    return rows.join(values, on)


#: The most cells of a table that goes to all tasks as one row: some 100 MB.
MOST = 1 << 22


def bounded(value: Column, cells: Column, other: str) -> Column:
    """value, or an error that names the other way where it holds more than MOST cells."""
    told = F.concat(F.lit("too many parameters for one row: "), cells.cast("string"), F.lit(f"; use {other}"))
    return F.when(cells <= MOST, value).otherwise(F.raise_error(told))


def with_lists(rows: DataFrame, few: DataFrame, key: str, fields: list[str], salts: int = 0) -> DataFrame:
    """Each row with each of few's rows of the same key, their fields as the struct _e.

    For a key of few values, on which a shuffle would put all rows into few tasks: few becomes one row, a map from
    key to list, and goes to all tasks, if it has no more than MOST rows. With salts, few's lists go to that many
    shares of each key's rows by a shuffle instead, and may be of any number.
    """
    lists = few.groupBy(key).agg(F.collect_list(F.struct(*fields)).alias("_l"))
    if salts:
        dealt = lists.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = rows.withColumn("_s", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
        return salted.join(dealt.hint("shuffle_hash"), [key, "_s"]).select(*rows.columns, F.explode("_l").alias("_e"))
    one = lists.agg(F.map_from_entries(F.collect_list(F.struct(key, "_l"))).alias("_m"), F.coalesce(F.sum(F.size("_l")), F.lit(0)).alias("_n"))
    one = one.select(bounded(F.col("_m"), F.col("_n"), "with_lists(salts=...)").alias("_m"))
    return rows.crossJoin(F.broadcast(one)).select(*rows.columns, F.explode(F.col("_m")[F.col(key)]).alias("_e"))


def as_map(key: str, value: Column | str) -> Column:
    """Aggregate: key to value."""
    return F.map_from_entries(F.collect_list(F.struct(F.col(key), (F.col(value) if isinstance(value, str) else value).alias("_v"))))


def dot(cells: Column, axis: str, value: str, weights: Column) -> Column:
    """Sum of value * weights[axis] over an array of structs; cells without a weight, or without a value, add nothing."""
    return F.aggregate(cells, F.lit(0.0), lambda s, c: s + F.coalesce(c[value] * weights[c[axis]], F.lit(0.0)))


def scatter(rows: DataFrame, to: list[str], name: str = "v", how: str = "sum") -> DataFrame:
    """Values that fall on the same index are summed (or how else is asked for)."""
    return rows.groupBy(*to).agg(getattr(F, how)(name).alias(name))


def gram(rows: DataFrame, cols: list[str], weight: Column, by: list[str], right: Column | None = None) -> DataFrame:
    """by, a, b, v: weighted sums of products of wide columns, from one aggregate without exploding pairs.

    With right, rows of b = -1 hold the products with it.
    """
    n = len(cols)
    sums = [F.sum(weight * F.col(cols[i]) * F.col(cols[j])).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]
    sums += [F.sum(weight * F.col(cols[i]) * right).alias(f"r{i}") for i in range(n)] if right is not None else []
    wide = rows.groupBy(*by).agg(*sums)
    cell = lambda a, b, c: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(c).alias("v"))
    cells = [cell(i, j, f"g{min(i, j)}_{max(i, j)}") for i in range(n) for j in range(n)]
    cells += [cell(i, -1, f"r{i}") for i in range(n)] if right is not None else []
    return wide.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.a", "c.b", "c.v")


def widen(rows: DataFrame, by: str, axis: str, values: list[int], name: str, prefix: str) -> DataFrame:
    """One row per by: a column for each given index of the axis, 0 where there is no cell."""
    return rows.groupBy(by).agg(*[F.coalesce(F.sum(F.when(F.col(axis) == k, F.col(name))), F.lit(0.0)).alias(f"{prefix}{k}") for k in values])


def cumulative_product(v: Column, by: list[str], order: str) -> Column:
    return F.product(v).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def suffix_sum(v: Column, by: list[str], order: str) -> Column:
    return F.sum(v).over(Window.partitionBy(*by).orderBy(order).rowsBetween(0, Window.unboundedFollowing))


def log_sum_exp(v: Column, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    m = F.max(v).over(w)
    return m + F.ln(F.sum(F.exp(v - m)).over(w))


def softmax(v: Column, by: list[str]) -> Column:
    return F.exp(v - log_sum_exp(v, by))


def densify(by: list[str], order: str) -> Column:
    """The index again without gaps, from 0."""
    return (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("int")


def stack(parts: list[tuple[DataFrame, int]], axis: str) -> DataFrame:
    """Concatenation along an axis: each part's index is shifted by its offset."""
    return reduce(DataFrame.unionByName, [p.withColumn(axis, F.col(axis) + offset) for p, offset in parts])


def split(rows: DataFrame, axis: str, start: int, end: int) -> DataFrame:
    """The part [start, end) of an axis, counted from 0."""
    return rows.filter((F.col(axis) >= start) & (F.col(axis) < end)).withColumn(axis, F.col(axis) - start)

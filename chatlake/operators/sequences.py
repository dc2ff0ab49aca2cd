"""Ordered groups of any size, by one plan.

A chat, a name or a handle may hold a large share of all rows. Positions in such a
group are counted in cells: a cell is a coarse step of the first ordering column
(a day, 65,536 ids, two letters), rows are numbered inside their cell, and the counts
of earlier cells are added. So the unit of work is a cell, not a group, and no size
has to be known before the plan is made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

# Values per row of a list; a longer list spreads over numbered parts.
PART_ROWS = 10_000


def cell_of(df: DataFrame, column: str) -> Column:
    """A coarse step of ``column`` that never decreases along its order."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.to_date(column)
    if isinstance(kind, T.IntegralType):
        return F.shiftright(F.col(column).cast("bigint"), 16)
    return F.substring(column, 1, 2) if isinstance(kind, T.StringType) else F.lit(0)


def group_index(df: DataFrame, keys: list[str], order: list[str], name: str = "message_index",
                cell: Column | None = None) -> DataFrame:
    """Add the 0-based position of each row in its group.

    ``order`` must be unique within a group; ``cell`` must not decrease along it.
    """
    marked = df.withColumn("_cell", cell_of(df, order[0]) if cell is None else cell)
    sizes = marked.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    places = [*keys, "_cell"]
    offsets = sizes.select(*[F.col(c).alias(f"_of_{c}") for c in places],
                           F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*places).orderBy(*order)
    numbered = marked.withColumn("_rank", F.row_number().over(within) - 1)
    same = reduce(lambda a, b: a & b, [numbered[c].eqNullSafe(offsets[f"_of_{c}"]) for c in places])
    index = (F.col("_rank") + F.col("_before")).cast("bigint")
    return numbered.join(offsets, same).withColumn(name, index).drop(
        "_cell", "_rank", "_before", *[f"_of_{c}" for c in places])


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group under ``order``.

    Every task keeps at most n rows of a group before the shuffle, as long as n is
    below the limit in ``session.RUNTIME_CONF``.
    """
    rank = "_rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    top = df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
    return top.withColumnRenamed(rank, name) if name else top.drop(rank)


def collect_parts(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str,
                  part_rows: int = PART_ROWS) -> DataFrame:
    """Ordered lists of at most ``part_rows`` values, numbered by ``part`` within a group.

    An ordinary group is one row with part 0; a huge one spreads over many rows.
    """
    placed = group_index(df, keys, order, "_position")
    parts = placed.groupBy(*keys, F.floor(F.col("_position") / part_rows).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("_position", value.alias("_value")))).alias("_items")
    )
    return parts.withColumn(name, F.transform("_items", lambda i: i["_value"])).drop("_items")

"""Joins of several rows per key with several rows per key, safe when one key is hot.

A key with a rows on one side and b rows on the other makes a * b result rows, all in the task that
owns the key. `product_join` first counts rows per key. Where no key makes much work the join is a plain
one. Hot keys are joined apart: their rows are reduced to distinct values with a count, and the key is
cut into a grid (`spread`): every side is an axis, its rows are divided over that axis by the hash of
their values and copied along the other axes. Each result row is made in exactly one grid cell.

Where the joined rows are only to be counted by a value of one side, they need not move: `by_value` brings the rows of a
value together with what they are to be joined with as an array, and the joined rows are made and counted there.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELL, CELLS = "_cell", "_cells"
# Joined rows one key may make in a single task.
MAX_KEY_PRODUCT = 10_000_000
# Keys treated apart. By the pigeonhole rule a key beyond them makes less than 1/MAX_HOT_KEYS of the work.
MAX_HOT_KEYS = 10_000
ROWS_PER_PART = 4_096
MAX_PARTS = 64
# Joined rows that a task makes or counts at a time, about.
TASK_JOINED = 2_000_000
# A value that makes the rows of more than so many tasks is cut.
HEAVY_TASKS = 8


@dataclass(frozen=True)
class Side:
    """One input of a join: the key and value columns.

    `by` names the columns that divide a hot key's rows; without it a key has few rows here, and they
    are copied to all parts. `weight` is a column that counts for more than one row. An `optional` side
    is joined to the left. `twin` is the position of an earlier side with the same rows.
    """

    df: DataFrame
    by: tuple[str, ...] = ()
    weight: str | None = None
    optional: bool = False
    twin: int | None = None
    rows_per_part: int = ROWS_PER_PART
    max_parts: int = MAX_PARTS


def key_sizes(sides: list[Side], key: str) -> DataFrame:
    """(key, _n0, _n1, ...): rows per key of every dividing side, from one narrow aggregation."""
    axes = [i for i, side in enumerate(sides) if side.by]
    counted = [i for i in axes if sides[i].twin is None]
    narrow = [
        sides[i].df.select(key, *[F.lit(int(i == j)).cast("bigint").alias(f"_n{j}") for j in counted]) for i in counted
    ]
    sizes = (
        reduce(DataFrame.unionByName, narrow)
        .filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[F.sum(f"_n{j}").alias(f"_n{j}") for j in counted])
    )
    return sizes.select(
        key, *[F.col(f"_n{i if sides[i].twin is None else sides[i].twin}").alias(f"_n{i}") for i in axes]
    )


def _product(sides: list[Side]) -> Column:
    counts = [F.greatest(F.col(f"_n{i}").cast("double"), F.lit(1.0)) for i, side in enumerate(sides) if side.by]
    return reduce(Column.__mul__, counts)


@dataclass(frozen=True)
class HotKeys:
    """The outcome of a check: keys to treat apart (at most MAX_HOT_KEYS), or None when there are none.

    `joined` has the rows that a join of some of the checked sides makes for the other keys, and `values`, where these
    are many, about how many different values a side has; both by the first column of `Side.by`.
    """

    keys: DataFrame | None
    joined: Mapping[frozenset[str], int] = field(default_factory=dict)
    values: Mapping[str, int] = field(default_factory=dict)

    def _known(self, sides: list[Side]) -> frozenset[str]:
        """The dividing sides as they were checked; one that was not counts like the first."""
        names = {name for known in self.joined for name in known}
        first = next(iter(self.joined), frozenset())
        return frozenset().union(*[{s.by[0]} if s.by[0] in names else first for s in sides if s.by])

    def rows(self, sides: list[Side]) -> int:
        return self.joined.get(self._known(sides), 0)

    def groups(self, sides: list[Side]) -> int:
        """At most so many different values (about) are among the joined rows."""
        most = prod(self.values.get(name, self.rows(sides)) for name in self._known(sides))
        return min(most, self.rows(sides))


def hot_keys(
    sides: list[Side], key: str, max_product: int | None = None, max_keys: int = MAX_HOT_KEYS
) -> HotKeys:
    """Find the keys that make more than `max_product` joined rows, hottest first.

    A key missing on a side counts as one row there, so a check over many sides also covers joins of
    some of them.
    """
    max_product = MAX_KEY_PRODUCT if max_product is None else max_product
    sizes = key_sizes(sides, key)
    is_hot = _product(sides) > max_product
    axes = {side.by[0]: F.greatest(F.col(f"_n{i}").cast("double"), F.lit(1.0)) for i, side in enumerate(sides) if side.by}
    subsets = [names for n in range(1, len(axes) + 1) for names in combinations(axes, n)]
    made = [F.sum(F.when(~is_hot, reduce(Column.__mul__, [axes[c] for c in names]))) for names in subsets]
    hot_count, *rows = sizes.agg(F.count_if(is_hot), *made).first()
    joined = {frozenset(names): int(n or 0) for names, n in zip(subsets, rows)}
    values = _value_counts(sides) if task_parts(sizes.sparkSession, max(joined.values(), default=0)) else {}
    if not hot_count:
        return HotKeys(None, joined, values)
    hot = sizes.filter(is_hot).orderBy(_product(sides).desc(), F.asc(key)).limit(max_keys)
    rows = hot.select(key).collect()  # at most max_keys
    return HotKeys(sizes.sparkSession.createDataFrame(rows, hot.select(key).schema), joined, values)


def _value_counts(sides: list[Side]) -> dict[str, int]:
    """About how many different values each dividing side has, by its first dividing column."""
    own = {side.by[0]: side for side in sides if side.by and side.twin is None}
    hashed = [s.df.select(*[(F.xxhash64(*s.by) if c == name else F.lit(None).cast("bigint")).alias(c) for c in own]) for name, s in own.items()]
    found = reduce(DataFrame.unionByName, hashed).agg(*[F.approx_count_distinct(c).alias(c) for c in own]).first()
    twins = {side.by[0]: found[sides[side.twin].by[0]] for side in sides if side.by and side.twin is not None}
    return {**{c: int(found[c] * 1.1) + 1 for c in own}, **{c: int(n * 1.1) + 1 for c, n in twins.items()}}


def task_parts(spark: SparkSession, rows: int) -> int | None:
    """Parts of about TASK_JOINED rows; None where the session's tasks are enough."""
    parts = -(-rows // TASK_JOINED)
    return parts if parts > max(spark.sparkContext.defaultParallelism, 1) else None


def dealt_groups(joined: DataFrame, sides: list[Side], hot: HotKeys, by: list[str], levels: int = 1) -> DataFrame:
    """Joined rows, to be grouped by `by` and more (`levels` times), in tasks of bounded size.

    Where the groups fit as many tasks as run at once the rows stay as they are, and are counted before their shuffle.
    Where they do not, counting so would gain little and fill the few partitions after it: the rows are dealt to more.
    """
    spark = joined.sparkSession
    parts = task_parts(spark, hot.rows(sides))
    fitting = max(spark.sparkContext.defaultParallelism, 1) * TASK_JOINED
    return joined if parts is None or levels * hot.groups(sides) <= fitting else joined.repartition(parts, *by)


def joined_parts(sides: list[Side], hot: HotKeys) -> int | None:
    """`task_parts` of the rows that the join of the sides makes."""
    return task_parts(sides[0].df.sparkSession, hot.rows(sides))


def heavy_values(weights: DataFrame, value: list[str], task_rows: int) -> DataFrame | None:
    """(*value, _cells) of the values that make more than HEAVY_TASKS * task_rows rows, or None; few, as each makes
    several tasks of all. `weights` has the rows a value makes as (*value, weight)."""
    cells = F.least(F.ceil(F.col("weight") / task_rows), F.lit(MAX_PARTS)).cast("bigint")
    found = weights.filter(F.col("weight") > HEAVY_TASKS * task_rows).select(*value, cells.alias(CELLS))
    rows = found.collect()
    return weights.sparkSession.createDataFrame(rows, found.schema) if rows else None


def by_value(rows: DataFrame, value: str, members: Column, heavy: DataFrame | None, parts: int) -> DataFrame:
    """Rows by the hash of `value` in `parts` tasks, with `_cell` and `_cells`.

    A row of a heavy value (see `heavy_values`) is copied to the cells of its `members`, an array; each cell makes the
    joined rows of its own members only (`in_cell`). Grouped by the value, `_cell` and more, rows do not move again.
    """
    if heavy is None:
        return rows.repartition(parts, value).withColumns({CELL: F.lit(0).cast("bigint"), CELLS: F.lit(None).cast("bigint")})
    known = F.broadcast(heavy.withColumnRenamed(value, "_heavy"))  # few, see `heavy_values`
    marked = rows.join(known, F.col(value).eqNullSafe(F.col("_heavy")), "left").drop("_heavy")
    cells = F.array_distinct(F.transform(members, lambda member: F.pmod(F.xxhash64(member), F.col(CELLS))))
    own = F.when(F.col(CELLS).isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(cells)
    return marked.withColumn(CELL, F.explode(own)).repartition(parts, value, CELL)


def in_cell(member: str) -> Column:
    """Whether a member of a row's array has its joined rows made in the row's cell."""
    return F.col(CELLS).isNull() | (F.pmod(F.xxhash64(member), F.col(CELLS)) == F.col(CELL))


def heavy_parts(sides: list[Side], key: str, max_keys: int = MAX_HOT_KEYS) -> DataFrame:
    """At most `max_keys` keys with their number of parts per axis; other keys stay in one cell."""
    axes = [i for i, side in enumerate(sides) if side.by]
    large = reduce(Column.__or__, [F.col(f"_n{i}") > sides[i].rows_per_part for i in axes])
    parts = [
        F.least(F.greatest(F.ceil(F.col(f"_n{i}") / sides[i].rows_per_part), F.lit(1)), F.lit(sides[i].max_parts))
        .cast("bigint")
        .alias(f"_parts{i}")
        for i in axes
    ]
    ordered = key_sizes(sides, key).filter(large).orderBy(_product(sides).desc(), F.asc(key))
    return ordered.limit(max_keys).select(key, *parts)


def _cells(axes: list[int], own: int | None, by: tuple[str, ...]) -> Column:
    """The grid cells a row of a divided key belongs to, as numbers."""
    strides: dict[int, Column] = {}
    stride: Column = F.lit(1).cast("bigint")
    for i in axes:
        strides[i] = stride
        stride = stride * F.col(f"_parts{i}")
    start = F.lit(0).cast("bigint")
    if own is not None:
        start = F.pmod(F.xxhash64(*by), F.col(f"_parts{own}")) * strides[own]
    cells = F.array(start)
    for i in axes:
        if i != own:
            cells = F.flatten(F.transform(cells, _along(i, strides[i])))
    return cells


def _along(axis: int, stride: Column):
    def copies(cell: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(f"_parts{axis}") - 1), lambda step: cell + step * stride)

    return copies


def spread(sides: list[Side], key: str, max_keys: int = MAX_HOT_KEYS) -> list[DataFrame]:
    """Each side with a `_cell` column to be joined (or cogrouped) on together with `key`."""
    axes = [i for i, side in enumerate(sides) if side.by]
    heavy = F.broadcast(heavy_parts(sides, key, max_keys))  # at most max_keys rows
    single = F.array(F.lit(0).cast("bigint"))
    result = []
    for i, side in enumerate(sides):
        cells = _cells(axes, i if side.by else None, side.by)
        marked = side.df.join(heavy, key, "left").withColumn(
            CELL, F.explode(F.when(F.col(f"_parts{axes[0]}").isNull(), single).otherwise(cells))
        )
        result.append(marked.select(*side.df.columns, CELL))
    return result


def _join_all(tables: list[DataFrame], sides: list[Side], on: list[str]) -> DataFrame:
    joined = tables[0]
    for table, side in zip(tables[1:], sides[1:]):
        joined = joined.join(table, on, "left" if side.optional else "inner")
    return joined


def _weighed(joined: DataFrame, weights: list[str | None]) -> DataFrame:
    factors = [F.coalesce(F.col(w), F.lit(1)) for w in weights if w]
    product = reduce(Column.__mul__, factors) if factors else F.lit(1)
    return joined.withColumn("n", product.cast("bigint")).drop(*[w for w in weights if w])


def product_join(
    sides: list[Side],
    key: str,
    distinct: bool = False,
    hot: HotKeys | None = None,
    max_keys: int = MAX_HOT_KEYS,
) -> DataFrame:
    """Equi-join of all sides on `key`, with `n`, the number of joined rows a result row stands for.

    With `distinct` every side counts as a set of rows and n is 1. Value columns of different sides
    need different names. `hot` is an earlier check of the same tables, else they are checked now; which
    keys are treated apart changes the work, never the result.
    """
    hot = hot or hot_keys(sides, key, max_keys=max_keys)
    plain = cool_join(sides, key, hot, distinct)
    return plain if hot.keys is None else plain.unionByName(hot_join(sides, key, hot, distinct, max_keys))


def cool_join(sides: list[Side], key: str, hot: HotKeys, distinct: bool = False) -> DataFrame:
    """The part of `product_join` for the keys that are not hot: a plain join, in tasks that make a bounded number of
    rows where every side is divided."""
    parts = task_parts(sides[0].df.sparkSession, hot.rows(sides)) if all(side.by and not side.optional for side in sides) else None
    tables = [cool_rows(side, key, hot.keys, distinct, parts) for side in sides]
    return _weighed(_join_all(tables, sides, [key]), [None if distinct else side.weight for side in sides])


def hot_join(
    sides: list[Side], key: str, hot: HotKeys, distinct: bool = False, max_keys: int = MAX_HOT_KEYS
) -> DataFrame:
    """The part of `product_join` for the hot keys: distinct values on a grid."""
    reduced = [_hot_values(side, i, key, hot.keys, distinct) for i, side in enumerate(sides)]
    split = _join_all(spread(reduced, key, max_keys), sides, [key, CELL]).drop(CELL)
    return _weighed(split, [f"_w{i}" for i in range(len(sides))])


def cool_rows(side: Side, key: str, hot: DataFrame | None, distinct: bool, parts: int | None) -> DataFrame:
    """The rows of a side whose key is not hot, by their key; with `distinct` each once."""
    rows = side.df
    if hot is not None:
        rows = rows.join(F.broadcast(hot), key, "left_anti")
    if parts is not None:
        # Without its key a row meets nothing, and all such rows would be in one task.
        rows = rows.filter(F.col(key).isNotNull()).repartition(parts, key)
    elif distinct and side.by:
        rows = rows.repartition(key)
    # No key is hot here: one shuffle on the key serves the distinct and the join.
    return rows.distinct() if distinct and side.by else rows


def _hot_values(side: Side, position: int, key: str, hot: DataFrame, distinct: bool) -> Side:
    """Rows of hot keys as distinct values and a count, combined before their shuffle."""
    rows = side.df.join(F.broadcast(hot), key, "left_semi")
    values = [column for column in rows.columns if column != side.weight]
    weight = F.sum(side.weight) if side.weight else F.count(F.lit(1))
    counted = rows.groupBy(*values).agg((F.max(F.lit(1)) if distinct else weight).alias(f"_w{position}"))
    return Side(counted, side.by, rows_per_part=side.rows_per_part, max_parts=side.max_parts)

"""Query-builder shapes that need more than one DataFrame call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import sums_before
from .skew import salted_join


def paginate(df: DataFrame, order: list[Column], page: int, per_page: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, total/per_page/current_page/last_page)."""
    rows = df.orderBy(*order).offset((max(1, page) - 1) * per_page).limit(per_page)
    size = F.lit(per_page).cast("bigint")
    info = df.agg(F.count("*").alias("total")).select(
        "total", size.alias("per_page"), F.lit(max(1, page)).cast("bigint").alias("current_page"),
        F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("total") / size)).alias("last_page"))
    return rows, info


def json_contains(json: Column, value: int | str | bool, path: str = "$") -> Column:
    """Whether the JSON value at ``path`` is the scalar ``value`` or an array that holds it; types must agree. NULL for broken JSON."""
    kind = "boolean" if isinstance(value, bool) else "bigint" if isinstance(value, int) else "string"
    tree = F.try_parse_json(json)

    def same(x: Column) -> Column:
        return (F.schema_of_variant(x) == kind.upper()) & (F.try_variant_get(x, "$", kind) == F.lit(value))

    items = F.try_variant_get(tree, path, "array<variant>")
    one = F.try_variant_get(tree, path, "variant")
    return F.when(tree.isNotNull(), F.coalesce(F.exists(items, same), same(one), F.lit(False)))


def in_both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` has too; NULL equals NULL."""
    return a.select(*keys).intersect(b.select(*keys))


def without(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``a`` less those of ``b``, each as often as it is left over."""
    return a.select(*keys).exceptAll(b.select(*keys))


def where_has(parents: DataFrame, children: DataFrame, on: list[str]) -> DataFrame:
    return parents.join(children.select(*on), on, "left_semi")


def where_missing(parents: DataFrame, children: DataFrame, on: list[str]) -> DataFrame:
    return parents.join(children.select(*on), on, "left_anti")


def with_related(parents: DataFrame, children: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per parent and child: the parent's columns, ``position`` of the child from 0, and the child's other columns.

    A parent without children has one row with NULLs. The shape is the same for any number of children: nothing is
    collected per parent, positions are counted over many tasks, and the children of one parent are spread over many as well.
    """
    placed = sums_before(children, [key], order, {"position": F.lit(1)})
    own, others = [c for c in parents.columns if c != key], [c for c in placed.columns if c != key]
    held = salted_join(placed, parents, [key], "inner").select(key, *(parents[c] for c in own), *(placed[c] for c in others))
    childless = parents.join(children.select(key).distinct(), key, "left_anti")
    return held.unionAll(childless.select(key, *own, *(F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in others)))


def morph(targets: dict[str, DataFrame], links: DataFrame, type_col: str, id_col: str) -> DataFrame:
    """Links joined to the table their type names; ``targets`` maps a type to (id, label)."""
    out = None
    for kind, table in targets.items():
        side = table.select(F.col("id").alias(id_col), F.col("label"))
        part = links.where(F.col(type_col) == kind).join(side, id_col, "left")
        out = part if out is None else out.unionByName(part)
    return out


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key; the rank filter prunes before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def alive(df: DataFrame, deleted: str = "deleted_at", trashed: str = "without") -> DataFrame:
    """Soft-delete scope: ``without``, ``with`` or ``only`` trashed rows."""
    if trashed == "with":
        return df
    gone = F.col(deleted).isNotNull()
    return df.where(gone if trashed == "only" else ~gone)


def map_chunks(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to Arrow batches on the executors; nothing passes through the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema)


def range_lookup(rows: DataFrame, value: str, bands: DataFrame, low: str, high: str, zone: str, cell: int) -> DataFrame:
    """Band whose [low, high) holds the value, per zone.

    Both sides get integer cells of width ``cell``, bands once per cell they touch, so
    the range condition rides on an equi-join instead of a nested loop. Bands must be finite.
    """
    left = rows.withColumn("_cell", F.floor(F.col(value) / cell).cast("bigint"))
    first = F.floor(F.col(low) / cell).cast("bigint")
    last = (F.ceil(F.col(high) / cell) - 1).cast("bigint")
    right = bands.withColumn("_cell", F.explode(F.sequence(first, F.greatest(first, last))))
    joined = salted_join(left, right, [zone, "_cell"], "inner")
    return joined.where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_cell")

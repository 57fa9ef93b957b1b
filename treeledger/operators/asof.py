"""As-of reads: the newest row of every entity at a sequence.

``newest`` keeps one row per key by ``max_by``, so partial aggregation drops superseded rows before the shuffle; the bound
on seq is a filter that reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, keys: list[str], at: int | Column | None = None) -> DataFrame:
    """Per key the row with the largest (seq, delta_index) of those with seq <= at. Filter on state after, never before."""
    if at is not None:
        rows = rows.where(F.col("seq") <= at)
    order = F.struct("seq", "delta_index") if "delta_index" in rows.columns else F.struct("seq")
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*keys, *(F.col(f"row.{c}").alias(c) for c in rest))


def intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with valid_from (its seq) and valid_to (the next row's seq; null while current), for many as-of points at once."""
    w = Window.partitionBy(*keys).orderBy("seq", "delta_index")
    return rows.withColumn("valid_from", F.col("seq")).withColumn("valid_to", F.lead("seq").over(w))


def asof_join(points: DataFrame, rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """For every point the row of its key that is newest at its own sequence (column ``at``), left outer.

    Points and rows are merged in one sorted stream per key, so there is no inequality join and nothing is broadcast.
    """
    rest = [c for c in rows.columns if c not in keys]
    marked = rows.select(*keys, F.col("seq").alias("_at"), F.lit(0).alias("_side"), F.struct(*rest).alias("_row"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_point"), F.col("delta_index").alias("_tie") if "delta_index" in rest else F.lit(0).alias("_tie"))
    asked = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(marked.schema["_row"].dataType).alias("_row"), F.struct(*points.columns).alias("_point"), F.lit(0).cast(marked.schema["_tie"].dataType).alias("_tie"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    got = marked.unionByName(asked).withColumn("_last", F.last("_row", ignorenulls=True).over(w)).where("_side = 1")
    return got.select(*(F.col(f"_point.{c}").alias(c) for c in points.columns), *(F.col(f"_last.{c}").alias(f"row_{c}") for c in rest))

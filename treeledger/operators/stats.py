"""Counters over a ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import families


def activity(deltas: DataFrame, after: int = 0) -> DataFrame:
    """content_bytes and file_revisions appended, and mutations (operations), after a sequence. One row."""
    rows = deltas.where(F.col("seq") > after)
    revised = families.revisions(rows).agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("content_bytes"), F.count("*").alias("file_revisions"))
    ops = rows.select("seq", "op_index").distinct().agg(F.count("*").alias("mutations"))
    return revised.crossJoin(ops)  # one row each


def footprint(deltas: DataFrame) -> DataFrame:
    """Rows and inodes by family."""
    parts = []
    for name, make in families.FAMILIES.items():
        rows = make(deltas)
        key = next(c for c in ("inode_id", "child_id", "root_id") if c in rows.columns)
        parts.append(rows.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("inodes")).select(F.lit(name).alias("family"), "rows", "inodes"))
    return reduce(DataFrame.unionByName, parts)


def digest(rows: DataFrame, *columns: str) -> DataFrame:
    """Order-insensitive digest of rows: equal for equal bags."""
    return rows.agg(F.count("*").alias("rows"), F.sum(F.crc32(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns)).cast("binary"))).alias("digest"))

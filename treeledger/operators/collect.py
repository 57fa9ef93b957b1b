"""Garbage collection: what is live, and what to do with every listed object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Grace periods and the size up to which fence and floor objects are told (fixed values).
GRACE_MS, SMALL_BYTES = 24 * 3600 * 1000, 572


def decisions(listed: DataFrame, live: DataFrame, now_ms: int) -> DataFrame:
    """listed: key, family (null: unrecognised), size_bytes, modified_ms. Adds decision and reason; the first rule that fits wins."""
    rows = listed.join(live.select("key").distinct().withColumn("is_live", F.lit(True)), "key", "left")
    age = F.lit(now_ms) - F.col("modified_ms")
    young = F.when(F.col("family") == "segment", age <= GRACE_MS).otherwise(age < GRACE_MS)
    reason = (
        F.when(F.col("family").isNull(), "unrecognized").when(F.col("is_live"), "referenced")
        .when(F.col("family").isin("fence", "floor") & (F.col("size_bytes") <= SMALL_BYTES), "permanent")
        .when(F.col("modified_ms").isNull(), "no_timestamp").when(young, "young").otherwise("unreferenced")
    )
    return rows.withColumn("reason", reason).drop("is_live").withColumn("decision", F.when(F.col("reason") == "unreferenced", "delete").otherwise("retain"))


def report(decided: DataFrame) -> DataFrame:
    return decided.groupBy("family", "decision", "reason").agg(F.count("*").alias("objects"), F.sum("size_bytes").alias("bytes"))


def live_contents(*revisions: DataFrame) -> DataFrame:
    """content_id that any member of a pool still refers to."""
    out = revisions[0].select("content_id")
    for r in revisions[1:]:
        out = out.unionByName(r.select("content_id"))
    return out.distinct()


def snapshots_visible(snapshots: DataFrame, now_ms: int, after: str | None = None, limit: int | None = None) -> DataFrame:
    """Snapshots that have not expired, ascending; expires_ms null never does."""
    out = snapshots.where(F.col("expires_ms").isNull() | (F.col("expires_ms") > now_ms))
    out = (out if after is None else out.where(F.col("snapshot_id") > after)).orderBy("snapshot_id")
    return out if limit is None else out.limit(limit)

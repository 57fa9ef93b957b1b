"""Namespaces and snapshots: small tables of lineage rows and pinned sequences.

namespaces: namespace_id, pool_id, state, fork_of, fork_point_seq, floor_seq, head_seq. An id is never used again, deleted or
not. A fork copies nothing: it reads its source up to the fork point. snapshots: namespace_id, snapshot_id, seq, expires_ms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import families

NAMESPACES = "namespace_id string, pool_id string, state string, fork_of string, fork_point_seq bigint, floor_seq bigint, head_seq bigint"
SNAPSHOTS = "namespace_id string, snapshot_id string, seq bigint, expires_ms bigint"
#: Rows of a page unless asked otherwise, and states (fixed values).
PAGE, ACTIVE, DELETED = 100, "active", "deleted"


def _one(namespaces: DataFrame, namespace: str):
    row = namespaces.where(F.col("namespace_id") == namespace).first()
    if row is None or row["state"] != ACTIVE:
        raise ValueError(f"namespace_not_found: {namespace}")
    return row


def _with(namespaces: DataFrame, row: tuple) -> DataFrame:
    if not namespaces.where(F.col("namespace_id") == row[0]).isEmpty():
        raise ValueError(f"namespace_exists: {row[0]}")
    return namespaces.unionByName(namespaces.sparkSession.createDataFrame([row], NAMESPACES))


def create(namespaces: DataFrame, namespace: str, pool: str) -> DataFrame:
    return _with(namespaces, (namespace, pool, ACTIVE, None, None, 0, 0))


def fork(namespaces: DataFrame, source: str, namespace: str, at: int | None = None) -> DataFrame:
    """A fork at a sequence of its source (its head), which may not lie below the source's floor."""
    s = _one(namespaces, source)
    point = s["head_seq"] if at is None else at
    if not s["floor_seq"] <= point <= s["head_seq"]:
        raise ValueError(f"below_retention_floor or past the head: {point}")
    return _with(namespaces, (namespace, s["pool_id"], ACTIVE, source, point, point, point))


def rebased(namespaces: DataFrame, fork_id: str, namespace: str, replayed: int) -> DataFrame:
    """The fork that stands for another after its changes were replayed on the source's head: forked there, with its own commits after."""
    f = _one(namespaces, fork_id)
    if f["fork_of"] is None:
        raise ValueError(f"not_a_fork: {fork_id}")
    made = fork(namespaces, f["fork_of"], namespace)
    return made.withColumn("head_seq", F.when(F.col("namespace_id") == namespace, F.col("head_seq") + replayed).otherwise(F.col("head_seq")))


def delete(namespaces: DataFrame, namespace: str) -> DataFrame:
    _one(namespaces, namespace)
    return namespaces.withColumn("state", F.when(F.col("namespace_id") == namespace, DELETED).otherwise(F.col("state")))


def page(namespaces: DataFrame, after: str | None = None, limit: int = PAGE) -> DataFrame:
    """Active namespaces, ascending; a page begins strictly after an id."""
    rows = namespaces.where(F.col("state") == ACTIVE)
    return (rows if after is None else rows.where(F.col("namespace_id") > after)).orderBy("namespace_id").limit(limit)


#: Tasks, about, that the rows of one namespace are dealt to (fixed value).
DEALT = 64


def lineage(namespaces: DataFrame, deltas: DataFrame) -> DataFrame:
    """Every row that each active namespace reads (reader): its own, and its source's up to the fork point. deltas: with namespace_id.
    One level of forks; a fork of a fork joins once more. A namespace's rows are dealt out by a hash, and each lineage row is repeated."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("_part")
    own = namespaces.where(F.col("state") == ACTIVE)
    rows = deltas.withColumn("_part", F.pmod(F.xxhash64("seq", "delta_index"), F.lit(DEALT)).cast("int"))
    mine = rows.join(own.select("namespace_id", F.col("namespace_id").alias("reader"), "fork_point_seq", parts), ["namespace_id", "_part"]).where("fork_point_seq is null or seq > fork_point_seq")
    theirs = rows.join(own.where("fork_of is not null").select(F.col("fork_of").alias("namespace_id"), F.col("namespace_id").alias("reader"), "fork_point_seq", parts), ["namespace_id", "_part"]).where("seq <= fork_point_seq")
    out = [*deltas.columns, "reader"]
    return mine.select(*out).unionByName(theirs.select(*out))


def statistics(deltas: DataFrame) -> DataFrame:
    """namespace_id, family, rows and bytes of content told in it, and the newest sequence. deltas: with namespace_id."""
    family = F.lit(None)
    for name, kinds in families.KINDS.items():
        family = F.when(F.col("kind").isin(*kinds), F.lit(name)).otherwise(family)
    return deltas.groupBy("namespace_id", family.alias("family")).agg(F.count("*").alias("rows"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("content_bytes"), F.max("seq").alias("last_seq"))


def retired(namespaces: DataFrame) -> DataFrame:
    """Deleted namespaces whose rows nothing reads any more: no active fork has them as its source."""
    needed = namespaces.where((F.col("state") == ACTIVE) & F.col("fork_of").isNotNull()).select(F.col("fork_of").alias("namespace_id"))
    return namespaces.where(F.col("state") == DELETED).join(needed, "namespace_id", "left_anti")


# ---- snapshots


def pin(snapshots: DataFrame, namespace: str, snapshot: str, seq: int, floor: int, head: int, expires_ms: int | None = None) -> DataFrame:
    if not floor <= seq <= head:
        raise ValueError(f"below_retention_floor or past the head: {seq}")
    if not snapshots.where((F.col("namespace_id") == namespace) & (F.col("snapshot_id") == snapshot)).isEmpty():
        raise ValueError(f"snapshot_exists: {snapshot}")
    return snapshots.unionByName(snapshots.sparkSession.createDataFrame([(namespace, snapshot, seq, expires_ms)], SNAPSHOTS))


def extended(snapshots: DataFrame, namespace: str, snapshot: str, expires_ms: int | None, now_ms: int) -> DataFrame:
    """With a later expiry; an expired snapshot stays expired."""
    mine = (F.col("namespace_id") == namespace) & (F.col("snapshot_id") == snapshot)
    alive = F.col("expires_ms").isNull() | (F.col("expires_ms") > now_ms)
    if snapshots.where(mine & alive).isEmpty():
        raise ValueError(f"snapshot_not_found: {snapshot}")
    later = F.lit(None).cast("bigint") if expires_ms is None else F.when(F.col("expires_ms").isNotNull(), F.greatest("expires_ms", F.lit(expires_ms)))
    return snapshots.withColumn("expires_ms", F.when(mine, later).otherwise(F.col("expires_ms")))


def unpinned(snapshots: DataFrame, namespace: str, snapshot: str) -> DataFrame:
    return snapshots.where((F.col("namespace_id") != namespace) | (F.col("snapshot_id") != snapshot))


def oldest_pins(snapshots: DataFrame, now_ms: int) -> DataFrame:
    """namespace_id and the least sequence that a living snapshot pins; a floor of collection may not pass it."""
    return snapshots.where(F.col("expires_ms").isNull() | (F.col("expires_ms") > now_ms)).groupBy("namespace_id").agg(F.min("seq").alias("pinned_seq"))

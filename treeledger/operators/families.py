"""Row families: projections of the delta ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S

_BY = ["committed_by", "committed_at_ms"]


def _of(deltas: DataFrame, *kinds: str) -> DataFrame:
    return deltas.where(F.col("kind").isin(*kinds))


def inodes(deltas: DataFrame) -> DataFrame:
    return _of(deltas, S.CREATE).select("inode_id", "inode_kind", "seq", *_BY)


def bindings(deltas: DataFrame) -> DataFrame:
    return _of(deltas, S.BIND, S.UNBIND).select("parent_id", "name_key", F.col("inode_id").alias("child_id"), F.col("inode_kind").alias("child_kind"), "seq", "delta_index", (F.col("kind") == S.BIND).alias("bound"), "display_name", *_BY)


def revisions(deltas: DataFrame) -> DataFrame:
    return _of(deltas, S.REVISE).select("inode_id", "revision_no", "seq", "delta_index", "content_id", "size_bytes", "checksum", *_BY)


def tombstones(deltas: DataFrame) -> DataFrame:
    return _of(deltas, S.DELETE, S.REVOKE).select(F.col("inode_id").alias("root_id"), "inode_kind", "seq", "delta_index", (F.col("kind") == S.DELETE).alias("is_set"), "target_seq", *_BY)


def trash_rows(deltas: DataFrame) -> DataFrame:
    """``listed`` at a deletion, ``removed`` at its revocation; both carry the deletion's sequence."""
    t = tombstones(deltas)
    return t.select("root_id", F.when(F.col("is_set"), F.col("seq")).otherwise(F.col("target_seq")).alias("deletion_seq"), F.when(F.col("is_set"), F.lit("listed")).otherwise(F.lit("removed")).alias("action"), "inode_kind", "seq", *_BY)


def attributes(deltas: DataFrame) -> DataFrame:
    return _of(deltas, S.ATTRIBUTES).select("inode_id", "attributes_revision_no", "seq", "delta_index", "attributes", *_BY)


def access(deltas: DataFrame) -> DataFrame:
    return _of(deltas, S.ACCESS).select("inode_id", "access_revision_no", "seq", "delta_index", "boundary", "grants", *_BY)


FAMILIES = {"inodes": inodes, "bindings": bindings, "revisions": revisions, "tombstones": tombstones, "trash": trash_rows, "attributes": attributes, "access": access}


def told(column) -> F.Column:
    """A map as text that is equal for equal maps: entries k=v in order of key, with semicolons between."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ";")


#: Kinds of delta that make each stored family.
KINDS = {"inodes": (S.CREATE,), "bindings": (S.BIND, S.UNBIND), "revisions": (S.REVISE,), "tombstones": (S.DELETE, S.REVOKE), "attributes": (S.ATTRIBUTES,), "access": (S.ACCESS,)}

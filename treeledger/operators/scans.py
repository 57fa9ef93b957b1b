"""Row lookups and scans over stored families: filters that reach the files, in key order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The columns that name a row of each family, in key order (newest first where a family keeps history).
KEYS = {"inodes": ["inode_id"], "bindings": ["parent_id", "name_key", "child_id", "seq", "delta_index"], "revisions": ["inode_id", "revision_no"], "tombstones": ["root_id", "seq", "delta_index"], "trash": ["deletion_seq", "root_id", "action"], "attributes": ["inode_id", "attributes_revision_no"], "access": ["inode_id", "access_revision_no"]}


def find_row(rows: DataFrame, **key) -> DataFrame:
    """The rows with these key values, one where they name a row; equality filters prune row groups by their statistics."""
    for c, v in key.items():
        rows = rows.where(F.col(c) == v)
    return rows


def scan_range(rows: DataFrame, key: str, lo=None, hi=None, limit: int | None = None, then: list[str] = ()) -> DataFrame:
    """Rows with lo <= key < hi in order of key (and of further columns); a page ends after ``limit``."""
    if lo is not None:
        rows = rows.where(F.col(key) >= lo)
    if hi is not None:
        rows = rows.where(F.col(key) < hi)
    rows = rows.orderBy(key, *then)
    return rows if limit is None else rows.limit(limit)


def combined(base: DataFrame, tail: DataFrame, folded: int, keys: list[str]) -> DataFrame:
    """A family as folded runs and the log's tail tell it together: the tail counts after the folded sequence alone, and a row that both
    have counts once."""
    return base.unionByName(tail.where(F.col("seq") > folded).select(*base.columns)).dropDuplicates(keys)


def receipt(commits: DataFrame, commit_id: str) -> DataFrame:
    """seq and fingerprint of the first commit of an id."""
    return commits.where(F.col("commit_id") == commit_id).groupBy("commit_id").agg(F.min_by(F.struct("seq", "fingerprint"), "seq").alias("r")).select("commit_id", "r.*")


def newest_merges(merges: DataFrame) -> DataFrame:
    """The latest merge of every source. merges: source, seq, source_through_seq."""
    rest = [c for c in merges.columns if c != "source"]
    return merges.groupBy("source").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("source", "r.*")


def commits_after(commits: DataFrame, after: int, limit: int, budget: int | None = None, size="size_bytes") -> DataFrame:
    """The next commits in order, at most ``limit``, while their sizes stay within the budget; the first always."""
    page = commits.where(F.col("seq") > after).orderBy("seq").limit(limit)
    if budget is None:
        return page
    w = Window.orderBy("seq")  # ``limit`` rows
    told = page.withColumn("_total", F.sum(size).over(w)).withColumn("_place", F.row_number().over(w))
    return told.where((F.col("_total") <= budget) | (F.col("_place") == 1)).drop("_total", "_place")

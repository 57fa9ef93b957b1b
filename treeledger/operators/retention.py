"""Retention: floors, the six rules, kept inodes, and compaction of a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..sources.shared import stored
from . import families, tree
from .asof import newest


def floor_at_time(commits: DataFrame, cutoff_ms: int, floor: int, head: int) -> int:
    """Largest sequence whose commit, and all before it, are not later than the cutoff; never below the present floor.

    Equals the one before the first later-dated commit, so a filtered minimum does without a running window.
    """
    first = commits.where((F.col("committed_at_ms") > cutoff_ms) & (F.col("seq") <= head)).agg(F.min("seq")).first()[0]
    return max(floor, head if first is None else first - 1)


def keep_commits(commits: DataFrame, floor: int) -> DataFrame:
    return commits.where(F.col("seq") >= floor)


def keep_whole_state(rows: DataFrame, number: str, floor: int) -> DataFrame:
    """Rows above the floor, and of each inode the newest at or below it."""
    old = rows.where(F.col("seq") <= floor)
    rest = [c for c in rows.columns if c != "inode_id"]
    best = old.groupBy("inode_id").agg(F.max_by(F.struct(*rest), number).alias("r")).select("inode_id", *(F.col(f"r.{c}").alias(c) for c in rest))
    return rows.where(F.col("seq") > floor).unionByName(best)


def repeated_numbers(rows: DataFrame, number: str, floor: int) -> DataFrame:
    """Inodes with two rows of one number at or below the floor; compaction refuses them."""
    return rows.where(F.col("seq") <= floor).groupBy("inode_id", number).count().where("count > 1")


def keep_trash(rows: DataFrame, floor: int) -> DataFrame:
    """Listed rows after the floor that were not revoked; no removal marker is kept."""
    gone = rows.where("action = 'removed'").select("deletion_seq", "root_id")
    return rows.where((F.col("action") == "listed") & (F.col("deletion_seq") > floor)).join(gone, ["deletion_seq", "root_id"], "left_anti")


def keep_bindings(rows: DataFrame, floor: int) -> DataFrame:
    """Rows above the floor, and of each edge (parent, name, child) its newest at or below it if that is bound."""
    keys = ["parent_id", "name_key", "child_id"]
    return rows.where(F.col("seq") > floor).unionByName(newest(rows, keys, floor).where("bound").select(*rows.columns))


def content_heads(revisions: DataFrame) -> DataFrame:
    """Of every file the revision with the longest content, the newest of equals."""
    rest = [c for c in revisions.columns if c != "inode_id"]
    return revisions.groupBy("inode_id").agg(F.max_by(F.struct(*rest), F.struct("size_bytes", "seq", "delta_index")).alias("r")).select("inode_id", *(F.col(f"r.{c}").alias(c) for c in rest))


def keep_layouts(rows: DataFrame, *first: str) -> DataFrame:
    """Of each content the longest layout, the newest of equals; or the greatest by other columns, and then so."""
    rest = [c for c in rows.columns if c != "content_id"]
    return rows.groupBy("content_id").agg(F.max_by(F.struct(*rest), F.struct(*first, "size_bytes", "seq")).alias("r")).select("content_id", *(F.col(f"r.{c}").alias(c) for c in rest))


def kept_inodes(deltas: DataFrame, head: int, floor: int, max_depth: int = S.MAX_DEPTH) -> DataFrame:
    """Inodes that the root, or a deletion still in the trash, reaches: an expired deletion hides what is below it for good."""
    return tree.readable(deltas, head, floor, max_depth).where("allowed").select("inode_id")


def compact(deltas: DataFrame, floor: int, head: int | None = None, drops_rows: bool = True) -> dict[str, DataFrame]:
    """The families of a compaction at a floor. Reads at or above the floor are unchanged. A compaction that leaves out the oldest
    run drops nothing. With a head, inodes that an expired deletion hides go too, and the bindings below them; tombstones stay."""
    f = {name: make(deltas) for name, make in families.FAMILIES.items()}
    if not drops_rows:
        return f
    if head is not None:
        kept = stored(kept_inodes(deltas, head, floor), "kept")
        for name in ("inodes", "revisions", "attributes", "access"):
            f[name] = f[name].join(kept, "inode_id", "left_semi")
        f["bindings"] = f["bindings"].join(kept.select(F.col("inode_id").alias("parent_id")), "parent_id", "left_semi")
    f["bindings"] = keep_bindings(f["bindings"], floor)
    for name, number in (("revisions", "revision_no"), ("attributes", "attributes_revision_no"), ("access", "access_revision_no")):
        f[name] = keep_whole_state(f[name], number, floor)
    f["trash"] = keep_trash(f["trash"], floor)
    return f


def as_deltas(kept: dict[str, DataFrame]) -> DataFrame:
    """Deltas that have the given families again (trash follows from tombstones), so that every read works on what was kept."""

    def made(rows: DataFrame, kind, **names: str) -> DataFrame:
        cols = {c: F.col(c) for c in rows.columns} | {k: F.col(v) for k, v in names.items()} | {"kind": kind}
        cols.setdefault("delta_index", F.lit(0))
        return rows.select(*(cols.get(c, F.lit(None)).cast(t).alias(c) for c, t in S.DELTA_COLUMNS.items()))

    b, t = kept["bindings"], kept["tombstones"]
    out = made(kept["inodes"], F.lit(S.CREATE))
    for part in (
        made(b, F.when(F.col("bound"), S.BIND).otherwise(S.UNBIND), inode_id="child_id", inode_kind="child_kind"),
        made(kept["revisions"], F.lit(S.REVISE)),
        made(t, F.when(F.col("is_set"), S.DELETE).otherwise(S.REVOKE), inode_id="root_id"),
        made(kept["attributes"], F.lit(S.ATTRIBUTES)),
        made(kept["access"], F.lit(S.ACCESS)),
    ):
        out = out.unionByName(part)
    return out


def merged_runs(runs: list[DataFrame], key: list[str]) -> DataFrame:
    """All rows of several runs, one for each row key."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.dropDuplicates(key)


def contiguous(log: DataFrame, folded: int) -> DataFrame:
    """Rows of a numbered log (seq) after the folded number, up to the first gap: replay stops there."""
    seqs = log.where(F.col("seq") > folded).select("seq").distinct()
    before = seqs.select((F.col("seq") + 1).alias("seq"))
    starts = seqs.join(before, "seq", "left_anti")  # rows whose predecessor is missing
    gap = starts.where(F.col("seq") > folded + 1).agg(F.min("seq")).first()[0]
    out = log.where(F.col("seq") > folded)
    return out if gap is None else out.where(F.col("seq") < gap)


def dedup_commits(log: DataFrame) -> DataFrame:
    """The first commit of every commit_id; ``conflict`` where a later one has another fingerprint."""
    first = F.min_by(F.struct("seq", "fingerprint"), "seq").alias("f")
    return log.groupBy("commit_id").agg(first, F.count("*").alias("attempts"), (F.count_distinct("fingerprint") > 1).alias("conflict")).select("commit_id", F.col("f.seq").alias("seq"), "attempts", "conflict")


def effective_floor(manifest_floor: int, tail_floors: DataFrame) -> int:
    got = tail_floors.agg(F.max("seq")).first()[0]
    return max(manifest_floor, got or 0)


#: A floor may not pass what is younger than this (fixed value).
RETAINED_MS = 24 * 3600 * 1000


def advanced_floor(commits: DataFrame, floor: int, head: int, now_ms: int, seq: int | None = None, cutoff_ms: int | None = None) -> int:
    """The new floor: as asked by sequence or cutoff time (neither: the head), but not past commits of the last RETAINED_MS, and
    never back."""
    asked = head if seq is None else min(seq, head)
    if cutoff_ms is not None:
        asked = min(asked, floor_at_time(commits, cutoff_ms, floor, head))
    return max(floor, min(asked, floor_at_time(commits, now_ms - RETAINED_MS, floor, head)))

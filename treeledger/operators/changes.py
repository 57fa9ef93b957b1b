"""Change data: events, the feed, and the difference of two sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..sources.shared import stored
from . import families, tree
from .asof import newest
from .reads import above_floor

#: What an operation's delta kinds, in order, mean (fixed values).
PATTERNS = {
    (S.CREATE, S.BIND): "directory_created",
    (S.CREATE, S.BIND, S.REVISE): "file_created",
    (S.REVISE,): "content_changed",
    (S.UNBIND, S.BIND): "moved",
    (S.UNBIND, S.DELETE): "deleted",
    (S.REVOKE, S.BIND): "restored",
    (S.ATTRIBUTES,): "attributes_changed",
    (S.ACCESS,): "access_changed",
}


def events(deltas: DataFrame, after: int = 0) -> DataFrame:
    """One event per operation after a sequence: seq, event_index, event_kind, inode_id and what the event tells. An operation
    whose deltas form no pattern has kind ``corrupt``."""
    rows = deltas.where(F.col("seq") > after)
    parts = F.sort_array(F.collect_list(F.struct("delta_index", "kind", "inode_id", "parent_id", "display_name", "revision_no", "content_id", "attributes_revision_no", "access_revision_no")))
    ops = rows.groupBy("seq", "op_index", "committed_by", "committed_at_ms").agg(parts.alias("d"))
    kinds = F.array_join(F.transform("d", lambda x: x["kind"]), ",")
    kind = F.lit("corrupt")
    for pattern, name in PATTERNS.items():
        kind = F.when(kinds == ",".join(pattern), F.lit(name)).otherwise(kind)
    first, last = F.col("d")[0], F.element_at("d", -1)
    bound = F.element_at(F.filter("d", lambda x: x["kind"] == S.BIND), 1)
    bound = F.when(F.size(F.filter("d", lambda x: x["kind"] == S.BIND)) > 0, bound)
    out = ops.select("seq", "op_index", kind.alias("event_kind"), first["inode_id"].alias("inode_id"), bound["parent_id"].alias("parent_id"), bound["display_name"].alias("display_name"), F.when(first["kind"] == S.UNBIND, first["parent_id"]).alias("source_parent_id"), F.when(first["kind"] == S.UNBIND, first["display_name"]).alias("source_display_name"), last["revision_no"].alias("revision_no"), last["content_id"].alias("content_id"), last["attributes_revision_no"].alias("attributes_revision_no"), last["access_revision_no"].alias("access_revision_no"), bound["delta_index"].alias("bind_index"), "committed_by", "committed_at_ms")
    w = Window.partitionBy("seq").orderBy("op_index")
    return out.withColumn("event_index", F.row_number().over(w) - 1)


def event_size(event_kind: str = "event_kind", display_name: str = "display_name"):
    """Bytes that an event counts for in a page: a fixed part, its kind and its name."""
    return F.lit(64) + F.octet_length(event_kind) + F.coalesce(F.octet_length(display_name), F.lit(0))


def feed(deltas: DataFrame, after: int, limit: int, budget: int | None = None, floor: int = 0) -> DataFrame:
    """Events of the next ``limit`` commits that have any, in order, and of these whole commits while their events' sizes stay within
    the budget; the first commit always. ``after`` may not lie below the floor."""
    above_floor(after, floor)
    page = deltas.where(F.col("seq") > after).select("seq").distinct().orderBy("seq").limit(limit)
    rows = events(deltas, after).join(page, "seq", "left_semi")
    if budget is not None:
        size = rows.groupBy("seq").agg(F.sum(event_size()).alias("size"))
        ahead = F.sum("size").over(Window.orderBy("seq"))  # a row for each of ``limit`` commits
        within = size.select("seq", "size", ahead.alias("total"), F.min("seq").over(Window.partitionBy(F.lit(0))).alias("first"))
        rows = rows.join(within.where((F.col("total") <= budget) | (F.col("seq") == F.col("first"))).select("seq"), "seq", "left_semi")
    return rows.orderBy("seq", "event_index")


def feed_within(deltas: DataFrame, after: int, budget: int, size) -> DataFrame:
    """Events from after a sequence until their sizes (a column) reach the budget; the first always, a commit may be split.

    A page is small: only commits that a bound on their number lets in (budget over the least size) are summed."""
    w = Window.orderBy("seq", "event_index").rowsBetween(Window.unboundedPreceding, 0)
    page = events(deltas, after).orderBy("seq", "event_index").limit(budget + 1)
    got = page.withColumn("event_bytes", size).withColumn("total", F.sum("event_bytes").over(w))
    return got.where((F.col("total") <= budget) | (F.col("total") == F.col("event_bytes"))).orderBy("seq", "event_index")


def touched(deltas: DataFrame, after: int, to: int) -> DataFrame:
    """inode_id and last_touch_seq of inodes with a delta of their own in (after, to]; a bind doesn't touch the parent."""
    return deltas.where((F.col("seq") > after) & (F.col("seq") <= to)).groupBy("inode_id").agg(F.max("seq").alias("last_touch_seq"))


def states(deltas: DataFrame, at: int, of: DataFrame, max_depth: int = S.MAX_DEPTH) -> DataFrame:
    """State of the given inodes: made, path (null unless visible), parent, name, and numbers of their newest rows. Maps are told
    as text."""
    keep = lambda df: df.join(of.select("inode_id"), "inode_id", "left_semi")
    out = keep(families.inodes(deltas).where(F.col("seq") <= at)).select("inode_id", "inode_kind").distinct()
    out = out.join(tree.paths(deltas, at, max_depth, of).select("inode_id", "path", "path_keys", "parent_id", "display_name"), "inode_id", "left")
    out = out.join(newest(keep(families.revisions(deltas)), ["inode_id"], at).select("inode_id", "revision_no", "content_id", F.col("seq").alias("revision_seq")), "inode_id", "left")
    out = out.join(newest(keep(families.attributes(deltas)), ["inode_id"], at).select("inode_id", "attributes_revision_no", families.told("attributes").alias("attributes"), F.col("seq").alias("attributes_seq")), "inode_id", "left")
    return out.join(newest(keep(families.access(deltas)), ["inode_id"], at).select("inode_id", "access_revision_no", families.told("grants").alias("grants"), "boundary", F.col("seq").alias("access_seq")), "inode_id", "left")


def diff(deltas: DataFrame, after: int, to: int, scope: list[str] = (), max_depth: int = S.MAX_DEPTH, floor: int = 0) -> DataFrame:
    """Touched inodes that differ between two sequences, by last touch and inode.

    Both ends are read only for touched inodes. With a scope: inodes at or below it at either end, and directories above it
    that were deleted, moved or restored.
    """
    above_floor(after, floor)
    t = stored(touched(deltas, after, to), "touched")
    a, b = states(deltas, after, t, max_depth), states(deltas, to, t, max_depth)
    pre = lambda df, p: df.select("inode_id", *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "inode_id"))
    rows = t.join(pre(a, "a"), "inode_id", "left").join(pre(b, "b"), "inode_id", "left")
    was, is_ = F.col("a_path").isNotNull(), F.col("b_path").isNotNull()
    differs = lambda c: ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    numbers = ["revision_no", "attributes_revision_no", "access_revision_no"]
    any_number = differs(numbers[0]) | differs(numbers[1]) | differs(numbers[2])
    kind = (
        F.when(~was & is_ & F.col("a_inode_kind").isNull(), "created").when(~was & is_, "restored").when(was & ~is_, "deleted")
        .when(was & is_ & (differs("parent_id") | differs("display_name")), "moved").when(was & is_ & any_number, "changed")
    )
    rows = rows.withColumn("kind", kind).where("kind is not null")
    if scope:
        n = len(scope)
        sc = F.array(*map(F.lit, scope)).cast("array<string>")
        below = lambda p: F.coalesce(F.slice(f"{p}_path_keys", 1, n) == sc, F.lit(False))
        above = lambda p: F.coalesce((F.size(f"{p}_path_keys") < n) & (F.slice(sc, F.lit(1), F.greatest(F.size(f"{p}_path_keys"), F.lit(0))) == F.col(f"{p}_path_keys")), F.lit(False))
        is_dir = F.coalesce("b_inode_kind", "a_inode_kind") == "directory"
        rows = rows.where(below("a") | below("b") | (is_dir & F.col("kind").isin("deleted", "moved", "restored") & (above("a") | above("b"))))
    told = lambda c: F.when(F.col("kind").isin("created", "restored"), F.col(f"b_{c}") if c == "revision_no" else F.lit(None)).when(F.col("kind").isin("moved", "changed") & differs(c), F.col(f"b_{c}"))
    out = rows.select("inode_id", "kind", F.coalesce("b_inode_kind", "a_inode_kind").alias("inode_kind"), F.col("b_path").alias("path"), F.when(F.col("kind").isin("moved", "deleted"), F.col("a_path")).alias("previous_path"), *(told(c).alias(c) for c in numbers), "last_touch_seq")
    return out.orderBy("last_touch_seq", "inode_id")


def append_offsets(deltas: DataFrame) -> DataFrame:
    """Every revision with its size and the size before it, where an append would begin."""
    w = Window.partitionBy("inode_id").orderBy("revision_no")
    return families.revisions(deltas).withColumn("append_offset", F.coalesce(F.lag("size_bytes").over(w), F.lit(0)))
